"""Corpus building: splits, unions, counts, name pools and generated examples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalforms.catalog.fields import LICENCE_DEFAULTS, STORED
from vitalforms.functions.patterns import CITIZENSHIPS, MONTHS
from vitalforms.functions.text import WHITESPACE, strip
from vitalforms.operators.ranking import (
    digest, flag_first, ranked, with_digest_bucket, with_position_bucket,
)


def _share(ratio: float, at_least: int = 0) -> Column:
    # the small addend keeps 0.1 * 10 and the like on the right side of floor
    size = F.floor(F.col("_total") * F.lit(ratio) + F.lit(1e-9))
    return F.greatest(size, F.lit(at_least)) if at_least else size


def stratified_split(df: DataFrame, group: str, position: str, ratio: float = 0.2,
                     booster: Column | None = None) -> DataFrame:
    """``split`` = dev for the first share of each group by position, else train.

    Each group gives at least one dev row; booster rows always train and do
    not count towards their group.  A NULL booster is none.
    """
    boosts = None if booster is None else F.coalesce(booster, F.lit(False))
    own = df if boosts is None else df.filter(~boosts)
    flagged = flag_first(with_position_bucket(own, position), position, _share(ratio, 1), [group])
    out = flagged.withColumn("split", F.when(F.col("chosen"), "dev").otherwise("train")).drop("chosen")
    if boosts is not None:
        out = out.unionByName(df.filter(boosts).withColumn("split", F.lit("train")))
    return out


def ordered_split(df: DataFrame, position: str, ratio: float = 0.8,
                  names: tuple[str, str] = ("train", "dev")) -> DataFrame:
    """First share by position is train, the rest dev."""
    flagged = flag_first(with_position_bucket(df, position), position, _share(ratio))
    return flagged.withColumn("split", F.when(F.col("chosen"), names[0]).otherwise(names[1])).drop("chosen")


def shuffled_split(df: DataFrame, key: str, ratio: float = 0.9, seed: int = 42,
                   names: tuple[str, str] = ("train", "val")) -> DataFrame:
    """Exact-size random split in digest order of the key."""
    keyed = with_digest_bucket(df.withColumn("_d", digest(F.col(key), seed=seed)), "_d")
    flagged = flag_first(keyed, "_d", _share(ratio))
    return flagged.withColumn("split", F.when(F.col("chosen"), names[0]).otherwise(names[1])).drop("chosen", "_d")


def validation_flags(df: DataFrame, group: str, key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """Exactly max(1, share) random rows of each group are validation rows."""
    keyed = with_digest_bucket(df.withColumn("_d", digest(F.col(key), seed=seed)), "_d")
    return flag_first(keyed, "_d", _share(ratio, 1), [group], out="is_val").drop("_d")


def fixed_sample(df: DataFrame, key: str, size: int = 200, seed: int = 42) -> DataFrame:
    """The same ``size`` random rows every time (all rows of a smaller table)."""
    keyed = with_digest_bucket(df.withColumn("_d", digest(F.col(key), seed=seed)), "_d")
    return flag_first(keyed, "_d", F.lit(size)).filter("chosen").drop("chosen", "_d")


def capped_split(df: DataFrame, position: str, cap: int | None = None, val_ratio: float = 0.1) -> DataFrame:
    """The first ``cap`` rows by position (all without one), cut into train and val in order."""
    taken = df if cap is None else flag_first(with_position_bucket(df, position), position, F.lit(cap)).filter("chosen").drop("chosen")
    return ordered_split(taken, position, 1 - val_ratio, ("train", "val"))


def merge_corpora(parts: Mapping[str, DataFrame | None]) -> DataFrame:
    """Union of named parts with a ``source`` column; missing parts are skipped."""
    out = None
    for name, part in parts.items():
        if part is None:
            continue
        tagged = part.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no corpus part given")
    return out


def corpus_counts(corpus: DataFrame, by: Sequence[str], spans: str | None = "spans",
                  skipped: str | None = None) -> DataFrame:
    """Documents, entities and skipped spans per source and split."""
    zero = F.lit(0).cast("long")
    entities = F.coalesce(F.sum(F.size(spans)), zero) if spans else zero
    return corpus.groupBy(*by).agg(
        F.count(F.lit(1)).alias("docs"), entities.cast("long").alias("entities"),
        (F.coalesce(F.sum(skipped), zero) if skipped else zero).cast("long").alias("skipped"))


def class_coverage(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct classes and whole rows per class (counted in two steps)."""
    per = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*by).agg(
        F.count(label).alias("classes"), F.sum("_n").alias("rows"),
        F.floor(F.sum("_n") / F.greatest(F.count(label), F.lit(1))).alias("per_class"))


def first_seen(df: DataFrame, name: str, position: str) -> DataFrame:
    """Distinct names with the position they first appear at and their rank."""
    firsts = df.groupBy(name).agg(F.min(position).alias("first_position"))
    return ranked(with_position_bucket(firsts, "first_position"), ["first_position"])


def combination_count(pools: Mapping[str, DataFrame], column: str) -> DataFrame:
    """Sizes of name pools and the number of combinations they allow."""
    spark = next(iter(pools.values())).sparkSession
    sizes = spark.range(1).select(*[df.agg(F.count_distinct(column)).scalar().alias(pool)
                                    for pool, df in pools.items()])
    product = F.lit(1).cast("decimal(38,0)")
    for pool in pools:
        product = (product * F.col(pool)).cast("decimal(38,0)")
    return sizes.withColumn("combinations", product)


# --- annotations -----------------------------------------------------------

# Form folders in the order they are looked for.
FOLDERS = ("form1a", "form2a", "form3a", "form90")


def folder_of(path: Column) -> Column:
    expr = F
    for f in FOLDERS:
        expr = expr.when(F.contains(path, F.lit(f)), f)
    return expr.otherwise(FOLDERS[0])


def repair_annotations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations under today's keys and paths, and the fixed/skipped counts.

    ``df`` has the columns image, image_path, label and text (any may be
    NULL): the legacy key wins when it is filled.
    """
    from vitalforms.functions.text import basename, or_chain

    both = df.select(or_chain(F.col("image"), F.col("image_path")).alias("_i"),
                     or_chain(F.col("label"), F.col("text")).alias("_t"))
    ok = (F.col("_i") != "") & (F.col("_t") != "")
    fixed = both.filter(ok).select(
        F.concat(folder_of(F.col("_i")), F.lit("/"), basename(F.col("_i"))).alias("image_path"),
        F.col("_t").alias("text"))
    counts = both.agg(F.count_if(ok).alias("fixed"), F.count_if(~ok).alias("skipped"))
    return fixed, counts


# --- generated examples ----------------------------------------------------

# Own pools of generated values.
SEXES = ("Female", "Male")
CIVIL = ("Single", "Married", "Annulled")
CAUSES = ("Stroke", "Dengue Fever", "Drowning", "Asthma", "Burns")
STREETS = ("Mabuhay Lane", "Harbour Road", "Old Mill Street")

# Own rule: the first ending that a stored field's name has gives the kind of its value.
KIND_BY_ENDING = (
    ("registry_no", "registry"), ("license_no", "registry"), ("first", "first"), ("middle", "last"), ("last", "last"),
    ("day", "day"), ("month", "month"), ("year", "year"), ("hospital", "venue"), ("venue", "venue"),
    ("municipality", "city"), ("city", "city"), ("province", "province"), ("citizenship", "citizenship"),
    ("civil_status", "civil"), ("sex", "sex"), ("age", "age"), ("age_years", "age"), ("date_issuance", "date"),
    ("date_submitted", "date"), ("prepared_by", "full_name"), ("immediate", "cause"), ("antecedent", "cause"),
    ("underlying", "cause"), ("residence", "address"),
)


def _kind(field: str) -> str:
    return next(kind for ending, kind in KIND_BY_ENDING if field.endswith(ending))


# Generated fields per form: what the form stores, each with the kind of its value.
GENERATED_FIELDS = {form: tuple((field, _kind(field)) for field in names) for form, names in {
    "1A": STORED["1A"], "2A": STORED["2A"], "3A": STORED["3A"],
    "90": (*LICENCE_DEFAULTS, "groom_residence", "bride_residence")}.items()}


def draw(key: Column, salt: str | Column, n: int) -> Column:
    """A repeatable pseudo-random number from 0 to n-1 for a row and a purpose."""
    seven = F.substring(F.md5(F.concat_ws("|", key.cast("string"), salt if isinstance(salt, Column) else F.lit(salt))), 1, 7)
    return F.conv(seven, 16, 10).cast("long") % n


def salted(salt: str | Column, purpose: str) -> str | Column:
    """The salt of one purpose."""
    return salt + purpose if isinstance(salt, str) else F.concat(salt, F.lit(purpose))


def pick(key: Column, salt: str | Column, pool: Sequence[str]) -> Column:
    """One entry of a small literal pool."""
    return F.element_at(F.array(*[F.lit(p) for p in pool]), (draw(key, salt, len(pool)) + 1).cast("int"))


def generated_value(kind: str, salt: str | Column, key: Column, first: Column, last: Column,
                    city: Column, province: Column) -> Column:
    """Value of one kind; names and places come from the row's own columns."""
    def number(purpose: str, low: int, count: int, width: int = 0) -> Column:
        text = (draw(key, salted(salt, purpose), count) + low).cast("string")
        return F.lpad(text, width, "0") if width else text

    pools = {"sex": SEXES, "civil": CIVIL, "cause": CAUSES, "month": MONTHS, "citizenship": CITIZENSHIPS}
    columns = {"first": first, "last": last, "city": city, "province": province}
    if kind in pools:
        return pick(key, salt, pools[kind])
    if kind in columns:
        return columns[kind]
    if kind == "full_name":
        return F.concat_ws(" ", first, last)
    if kind == "venue":
        return F.concat(city, F.lit(" Hall "), number("", 1, 7))
    if kind == "address":
        return F.concat_ws(", ", F.concat_ws(" ", number("", 1, 250), pick(key, salted(salt, "street"), STREETS)), city, province)
    if kind == "registry":
        return F.concat(number("year", 1985, 40), F.lit("-"), number("serial", 100, 89_900, 5))
    if kind == "date":
        return F.concat_ws("-", number("year", 1985, 40), number("month", 1, 12, 2), number("day", 1, 31, 2))
    low, count = {"day": (1, 31), "year": (1985, 40), "age": (0, 105)}[kind]
    return number("", low, count)


def generate_field_values(seeds: DataFrame, form: str, samples: int = 1, val_percent: int = 10) -> DataFrame:
    """(seed_id, form, sample, field, text, split): ``samples`` values of every field of a form per seed.

    ``seeds`` has (seed_id, first_name, last_name, city, province); values
    and the split depend on seed, sample and field only, so a lost task gives
    the same rows again.  About ``val_percent`` of the rows are ``val``, the
    rest ``train``.  Blank values are left out.
    """
    names = ("first_name", "last_name", "city", "province")
    drawn = seeds.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples)))).select(
        "seed_id", "sample", *names, F.concat_ws(".", F.col("seed_id").cast("string"), F.col("sample").cast("string")).alias("_key"))
    # one row a field before its value is drawn: the expression holds each kind once instead of each field, which the JVM compiles
    each = drawn.select("*", F.inline(F.array(*[F.struct(F.lit(field).alias("field"), F.lit(kind).alias("_kind"))
                                               for field, kind in GENERATED_FIELDS[form]])))
    key, field, value = F.col("_key"), F.col("field"), F
    for kind in dict.fromkeys(kind for _, kind in GENERATED_FIELDS[form]):
        value = value.when(F.col("_kind") == kind, generated_value(kind, field, key, *map(F.col, names)))
    # a value from a generator is not drawn again by the filter on it
    rows = each.select("seed_id", "sample", "field", "_key", F.explode_outer(F.array(value)).alias("text"))
    return rows.filter(F.col("text").rlike(f"[!-~]|[^{WHITESPACE}]")).select(
        "seed_id", F.lit(form).alias("form"), "sample", "field", "text",
        F.when(draw(key, salted(field, "split"), 100) < val_percent, "val").otherwise("train").alias("split"))


# Own sentences of the labelled text generator, five per class.
TEXT_PATTERNS = {
    "form102": (
        "Form 102: {a}, {s}, came into the world on {d}. The baby was delivered in {p}.",
        "We register the live birth of {a} in {p}; {b} is the parent who reported the newborn on {d}.",
        "Newborn record, {p}. Baby: {a}. Delivered {d}. Midwife on duty: {b}.",
        "{b} gave birth to a {s} baby, {a}, on {d}; live birth entered in the register of {p}.",
        "Birth entry {d}: infant {a}, {s}, delivered in {p}, midwife {b}.",
    ),
    "form103": (
        "Form 103: {a} passed away on {d}. The physician gives {c} as the reason of death.",
        "We register the death of {a} in {p}; {b} claimed the remains on {d}.",
        "Death record, {p}. Deceased: {a}. Physician found {c}. Burial {d}.",
        "The remains of {a} were released to {b} for burial on {d} after death from {c}.",
        "Death entry {d}: {a} deceased in {p}, physician {b}, {c}.",
    ),
    "form97": (
        "Form 97: {a} and {b} exchanged vows on {d}. The wedding took place in {p}.",
        "We register the marriage of {a} with {b}, celebrated in {p} on {d}.",
        "Marriage record, {p}. Groom: {a}. Bride: {b}. Wedding day {d}.",
        "Bride {b} and groom {a} signed the marriage contract in {p} on {d}.",
        "Marriage entry {d}: spouses {a} and {b}, wedding in {p}.",
    ),
}


def generate_labelled_texts(seeds: DataFrame) -> DataFrame:
    """(seed_id, label, text): one text per class and seed from a drawn sentence."""
    key = F.col("seed_id")
    slots = {
        "a": F.concat_ws(" ", "first_name", "last_name"), "b": F.concat_ws(" ", "last_name", "first_name"),
        "d": generated_value("date", "text", key, F.lit(""), F.lit(""), F.lit(""), F.lit("")),
        "p": F.concat_ws(", ", "city", "province"),
        "s": pick(key, "text-sex", SEXES), "c": pick(key, "text-cause", CAUSES),
    }

    def written(pattern: str) -> Column:
        parts = [F.lit(plain) if slot is None else slots[slot]
                 for literal, name, *_ in Formatter().parse(pattern)
                 for plain, slot in ((literal, None), ("", name)) if plain or slot]
        return F.concat(*parts)

    texts = F.array(*[F.struct(F.lit(label).alias("label"), F.element_at(
        F.array(*map(written, options)), (draw(key, label, len(options)) + 1).cast("int")).alias("text"))
        for label, options in TEXT_PATTERNS.items()])
    return seeds.select("seed_id", F.inline_outer(texts))


def annotated_examples(rendered: DataFrame, key: str, text: str, values: Mapping[str, Column]) -> DataFrame:
    """(key, text, spans): label values found back in a rendered form.

    ``values`` maps a label to its value column, in reading order.
    """
    from vitalforms.functions.spans import locate_phrases

    pairs = F.array(*[F.struct(v.alias("phrase"), F.lit(label).alias("label")) for label, v in values.items()])
    some = F.filter(pairs, lambda p: F.coalesce(strip(p["phrase"]), F.lit("")) != "")
    return rendered.withColumn("_pairs", some).select(
        key, text, locate_phrases(F.col(text), F.col("_pairs")).alias("spans"))
