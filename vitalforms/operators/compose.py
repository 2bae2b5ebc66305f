"""Field dictionaries rendered as form text, screen fields and reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalforms.catalog import fields as cat
from vitalforms.functions import fragments as sql

# The lines of each rendered form.  A field stands in braces,
# alternatives are separated by "|"; the first filled one is printed.
BIRTH_TEXT = """\
Registry No.: {registry_number|registry_no}
Date of Registration: {date_of_registration}
1. NAME (First): {child_first_name}  (Middle): {child_middle_name}  (Last): {child_last_name}
2. SEX: {sex}
3. DATE OF BIRTH: {dob_month} {dob_day}, {dob_year}
4. PLACE OF BIRTH: {place_birth_hospital} {place_birth_city} {place_birth_province}
MOTHER:
7. MAIDEN NAME (First): {mother_first_name}  (Middle): {mother_middle_name}  (Last): {mother_last_name}
8. CITIZENSHIP/NATIONALITY: {nationality_of_mother|mother_citizenship|mother_nationality}
FATHER:
14. NAME (First): {father_first_name}  (Middle): {father_middle_name}  (Last): {father_last_name}
15. CITIZENSHIP/NATIONALITY: {nationality_of_father|father_citizenship|father_nationality}
MARRIAGE OF PARENTS:
20a. DATE: {parents_marriage_month} {parents_marriage_day}, {parents_marriage_year}
20b. PLACE: {parents_marriage_city} {parents_marriage_province}
"""

DEATH_TEXT = """\
Registry No.: {registry_number|registry_no}
Date of Registration: {date_of_registration}
1. NAME (First): {deceased_first_name}  (Middle): {deceased_middle_name}  (Last): {deceased_last_name}
2. SEX: {sex}
4. AGE: {age|age_years}
9. CIVIL STATUS: {civil_status}
7. CITIZENSHIP/NATIONALITY: {nationality|citizenship}
6. DATE OF DEATH: {dod_month} {dod_day}, {dod_year}
5. PLACE OF DEATH: {place_death_hospital} {place_death_city} {place_death_province}
17. CAUSE OF DEATH: {cause_of_death|cause_immediate}
Antecedent cause: {cause_antecedent}
Underlying cause: {cause_underlying}
"""

_SPOUSE_TEXT = """\
ROLE:
1. NAME (First): {role_first_name}  (Middle): {role_middle_name}  (Last): {role_last_name}
2b. AGE: {role_age}
4b. CITIZENSHIP/NATIONALITY: {role_nationality|role_citizenship}
8. NAME OF FATHER (First): {role_father_first}  (Middle): {role_father_middle}  (Last): {role_father_last}
8b. FATHER CITIZENSHIP/NATIONALITY: {role_father_nationality|role_father_citizenship}
10. NAME OF MOTHER (First): {role_mother_first}  (Middle): {role_mother_middle}  (Last): {role_mother_last}
10b. MOTHER CITIZENSHIP/NATIONALITY: {role_mother_nationality|role_mother_citizenship}
"""

MARRIAGE_TEXT = (
    "Registry No.: {registry_number|registry_no}\n"
    "Date of Registration: {date_of_registration}\n"
    + "".join(_SPOUSE_TEXT.replace("ROLE", r.upper()).replace("role_", f"{r}_") for r in ("husband", "wife"))
    + "15. PLACE OF MARRIAGE: {place_marriage_city} {place_marriage_province}\n"
    "16. DATE OF MARRIAGE: {date_marriage_month} {date_marriage_day}, {date_marriage_year}\n"
)

_APPLICANT_TEXT = """\
ROLE:
1. NAME (First): {first_name|child_first_name}  (Middle): {middle_name|child_middle_name}  (Last): {last_name|child_last_name}
2. DATE OF BIRTH: {dob_month} {dob_day}, {dob_year}
3. PLACE OF BIRTH: {place_birth_hospital} {place_birth_city} {place_birth_province}
4. SEX: {sex}
5. CITIZENSHIP/NATIONALITY: {citizenship|nationality|nationality_of_mother|mother_citizenship}
NAME OF FATHER (First): {father_first_name}  (Middle): {father_middle_name}  (Last): {father_last_name}
FATHER CITIZENSHIP/NATIONALITY: {father_citizenship|father_nationality}
NAME OF MOTHER (First): {mother_first_name}  (Middle): {mother_middle_name}  (Last): {mother_last_name}
MOTHER CITIZENSHIP/NATIONALITY: {mother_citizenship|mother_nationality}
"""

FORM_TEXT = {
    "birth": BIRTH_TEXT,
    "death": DEATH_TEXT,
    "marriage": MARRIAGE_TEXT,
    "groom": _APPLICANT_TEXT.replace("ROLE", "GROOM"),
    "bride": _APPLICANT_TEXT.replace("ROLE", "BRIDE"),
}


def template_parts(template: str) -> list[tuple[str, tuple[str, ...]]]:
    """(literal, alternatives) pieces of a template; one of the two is empty."""
    parts: list[tuple[str, tuple[str, ...]]] = []
    for chunk in template.split("{"):
        names, brace, literal = chunk.partition("}")
        if not brace:
            literal = chunk
        else:
            parts.append(("", tuple(names.split("|"))))
        if literal:
            parts.append((literal, ()))
    return parts


def render(template: str, get: sql.Get, strip: Callable[[str], str] = sql.strip) -> str:
    """Expression that fills a template from a field getter.

    The pieces are joined outside of any lambda, so that they are compiled.
    """
    pieces = ["''"]
    for literal, keys in template_parts(template):
        filled = ", ".join(sql.not_empty(strip(get(k))) for k in keys)
        pieces.append(sql.text(literal) if literal else f"coalesce({filled}, '')")
    return sql.apart(f"concat({', '.join(pieces)})")


def with_rendered(df: DataFrame, fields: str, kinds: Mapping[str, str] | str, out: str = "form_text") -> DataFrame:
    """Add the text of a form kind, or of several kinds by their SQL conditions (the last is taken where none holds).

    The fields that a form prints are looked up once, in a column of their own.
    """
    each = {kinds: "true"} if isinstance(kinds, str) else dict(kinds)
    looked, texts = [], []
    for kind in each:
        keys = list(dict.fromkeys(k for _, names in template_parts(FORM_TEXT[kind]) for k in names))
        found = [sql.key_of(fields)(k) for k in keys]
        looked.append(f"array({', '.join([sql.apart(found[0]), *found[1:]])})")
        texts.append(render(FORM_TEXT[kind], lambda k, keys=keys: f"get(_looked, {keys.index(k)})", sql.quick_strip))

    def chosen(cases: list[str]) -> Column:
        arms = "".join(f" WHEN {test} THEN {case}" for test, case in zip([*each.values()][:-1], cases))
        return F.expr(f"CASE{arms} ELSE {cases[-1]} END" if arms else cases[0])

    return df.withColumn("_looked", chosen(looked)).withColumn(out, chosen(texts)).drop("_looked")


def form_text(fields: str, kind: str) -> Column:
    """Text of one form kind rendered from a field map column."""
    return F.expr(render(FORM_TEXT[kind], sql.key_of(fields)))


def detect_form_type(fields: str) -> Column:
    """Form told by the keys of a field dictionary: birth, death, marriage."""
    def any_of(names: tuple[str, ...]) -> str:
        return f"arrays_overlap(map_keys({fields}), {sql.text_array(names)})"

    return F.expr(
        f"CASE WHEN {any_of(cat.BIRTH_KEYS)} THEN 'birth' WHEN {any_of(cat.DEATH_KEYS)} THEN 'death' "
        f"WHEN {any_of(cat.MARRIAGE_KEYS)} THEN 'marriage' ELSE 'birth' END")


def with_text_of_type(df: DataFrame, fields: str, form_type: str, out: str = "form_text") -> DataFrame:
    """Add the rendered text of a field dictionary; unknown types render as birth."""
    kinds = {k: f"{form_type} = {sql.text(k)}" for k in ("death", "marriage")}
    return with_rendered(df, fields, kinds | {"birth": "true"}, out)


# --- raw result -> stored fields -----------------------------------------

def stored_expressions(raw: str, hint: str) -> dict[str, str]:
    """Stored field -> expression over raw keys, by alias; compiled but for the first, which keeps them apart."""
    get = sql.key_of(raw)
    chains = {target: sql.filled_chain(*[get(s) for s in sources]) for target, sources in cat.STORED[hint].items()}
    first = next(iter(chains))
    return chains | {first: sql.apart(chains[first])}


def stored_fields(raw: str, hint: str, passthrough: bool = True) -> str:
    """Expression of the stored field map of a raw result.

    Unmapped raw keys that hold a value are carried along.
    """
    mapped = stored_expressions(raw, hint)
    if not passthrough:
        return sql.as_map(mapped)
    known = ", ".join(sql.text(k) for k in mapped)  # a list of literals becomes a hash set
    extra = f"map_filter({raw}, (k, v) -> k NOT IN ({known}) AND coalesce(v, '') <> '')"
    return f"map_concat({sql.as_map(mapped)}, {extra})"


def mapped_confidence(raw: str) -> Column:
    """The same fixed confidence for every raw key."""
    return F.expr(f"transform_values({raw}, (k, v) -> {cat.MAPPED_CONFIDENCE}D)")


def licence_page(raw: str, spouse: str, role: str, parse: bool = False) -> str:
    """Expression of the stored fields of one licence page; blank ones go.

    ``spouse`` is the nested person map of the role.  The marriage date is
    split at commas, so ``June 5, 2001`` puts ``June 5`` into the day; with
    ``parse`` a recognised date gives its real parts instead.
    """
    get, person = sql.key_of(raw), sql.key_of(spouse)
    when, where = get("date_of_marriage"), get("place_of_marriage")
    parts = {p: sql.comma_part(when, i) for i, p in enumerate(("day", "month", "year"))}
    if parse:
        tidy = f"regexp_replace({sql.strip(when)}, '[ ]+', ' ')"
        date = f"coalesce(try_to_timestamp({tidy}, 'MMMM d, yyyy'), try_to_timestamp({tidy}, 'M/d/yyyy'))"
        parts = {p: f"coalesce(date_format({date}, {sql.text(f)}), {parts[p]})"
                 for p, f in (("day", "d"), ("month", "MMMM"), ("year", "yyyy"))}

    def value(*xs: str) -> str:
        return sql.strip(sql.or_chain(*xs))

    out = {
        "registry_no": value(get("registry_number")),
        "city_municipality": sql.comma_part(where, 1),
        "date_issuance": value(get("date_of_registration")),
        "license_no": value(get("license_no"), get("license_number")),
        "marriage_day": parts["day"], "marriage_month": parts["month"], "marriage_year": parts["year"],
        "marriage_venue": sql.comma_part(where, 0),
        "marriage_city": sql.comma_part(where, 1),
        "marriage_province": value(get("province")),
    }
    for field, keys in cat.LICENCE_PERSON.items():
        top = [get(f"{role}_{field}")] if field in cat.LICENCE_TOP_LEVEL else []
        out[f"{role}_{field}"] = value(*[person(k) for k in keys], *top)
    return f"map_filter({sql.as_map(out)}, (k, v) -> v <> '')"


def merge_last_wins(first: str, second: str) -> str:
    """Expression of the union of two maps; the second wins on shared keys."""
    empty = "cast(map() as map<string, string>)"
    rest = f"map_filter({first}, (k, v) -> NOT coalesce(map_contains_key({second}, k), false))"
    return f"map_concat(coalesce({rest}, {empty}), coalesce({second}, {empty}))"


def licence_pages(groom: str, bride: str) -> str:
    """Both pages in one map: the groom page wins, expected keys always exist."""
    defaults = sql.as_map({k: "''" for k in cat.LICENCE_DEFAULTS})
    return merge_last_wins(defaults, merge_last_wins(bride, groom))


# --- screen fields ---------------------------------------------------------

def screen_fields(fields: str, hint: str) -> dict[str, str]:
    """Expressions of an editable form; parents, hospital and role fall back."""
    r, either_of = sql.key_of(fields), sql.or_chain
    p = {"1A": "f1a", "2A": "f2a"}.get(hint, "f3a")
    shared = {"city": "city_municipality", "date": "date_issuance", "registry": "registry_no",
              "issued_to": "issued_to", "verified_by": "processed_by", "verified_pos": "verified_position",
              "amount": "amount_paid", "or_number": "or_number", "date_paid": "date_paid"}
    out = {f"{p}_{k}": either_of(r(v)) for k, v in shared.items()}
    out[f"{p}_date_reg"] = either_of(r("date_submitted"), r("date_received"))

    def full(q: str) -> str:
        return sql.screen_name(r(f"{q}_first"), r(f"{q}_middle"), r(f"{q}_last"))

    def date(q: str) -> str:
        return sql.screen_date(r(f"{q}_month"), r(f"{q}_day"), r(f"{q}_year"))

    if hint == "1A":
        out |= {
            f"{p}_child_name": full("child"), f"{p}_sex": either_of(r("sex")), f"{p}_dob": date("dob"),
            f"{p}_pob": sql.screen_place(r("pob_city"), r("pob_province")),
            f"{p}_mother_name": full("mother"), f"{p}_mother_nat": either_of(r("mother_citizenship")),
            f"{p}_father_name": full("father"), f"{p}_father_nat": either_of(r("father_citizenship")),
            f"{p}_marriage_date": date("parents_marriage"),
            f"{p}_marriage_place": sql.screen_place(r("parents_marriage_city"), r("parents_marriage_province")),
        }
    elif hint == "2A":
        out |= {
            f"{p}_deceased_name": full("deceased"), f"{p}_sex": either_of(r("sex")),
            f"{p}_age": either_of(r("age_years")), f"{p}_civil_status": either_of(r("civil_status")),
            f"{p}_nationality": either_of(r("citizenship")), f"{p}_dod": date("dod"),
            f"{p}_pod": sql.screen_place(either_of(r("pod_hospital"), r("pod_city")), r("pod_province")),
            f"{p}_cause": either_of(r("cause_immediate")),
        }
    else:
        out[f"{p}_dom"] = date("marriage")
        out[f"{p}_pom"] = sql.screen_place(
            either_of(r("marriage_venue"), r("marriage_city")), r("marriage_province"))
        for shown, page in (("husband", "groom"), ("wife", "bride")):
            def role(f: str, a: str = shown, b: str = page) -> str:
                return either_of(r(f"{a}_{f}"), r(f"{b}_{f}"))

            out[f"{p}_{shown}_name"] = sql.screen_name(role("first"), role("middle"), role("last"))
            out[f"{p}_{shown}_age"] = role("age")
            out[f"{p}_{shown}_nat"] = role("citizenship")
            for parent in ("mother", "father"):
                out[f"{p}_{shown}_{parent}"] = sql.screen_name(role(f"{parent}_first"), role(f"{parent}_last"))
                out[f"{p}_{shown}_{parent}_nat"] = role(f"{parent}_citizenship")
    return out


def canonical_edit_key(key: Column) -> Column:
    """Stored name of an edited element key, NULL when it is not a field."""
    flat = {k: v[0] for k, v in cat.EDITED_KEYS.items()}
    for role in ("husband", "wife"):
        flat |= {f"{role}_name": f"{role}_name", f"{role}_age": f"{role}_age",
                 f"{role}_nat": f"{role}_citizenship"}
        for parent in ("mother", "father"):
            flat |= {f"{role}_{parent}": f"{role}_{parent}_name",
                     f"{role}_{parent}_nat": f"{role}_{parent}_citizenship"}
    suffix = F.regexp_extract(key, r"^f[123]a_(.+)$", 1)
    known = F.array_contains(F.expr(sql.text_array(cat.DATA_FIELDS)), key)
    return F.coalesce(F.expr(sql.as_map({k: sql.text(v) for k, v in flat.items()}))[suffix], F.when(known, key))


# --- reports ---------------------------------------------------------------

# Certificate lines, label = screen field suffix.
REPORT_LINES = {
    "1A": (("Registry Number", "registry"), ("Date of Registration", "date_reg"),
           ("Name of Child", "child_name"), ("Sex", "sex"), ("Date of Birth", "dob"),
           ("Place of Birth", "pob"), ("Name of Mother", "mother_name"),
           ("Nationality of Mother", "mother_nat"), ("Name of Father", "father_name"),
           ("Nationality of Father", "father_nat"), ("Date of Marriage of Parents", "marriage_date"),
           ("Place of Marriage of Parents", "marriage_place")),
    "2A": (("Registry Number", "registry"), ("Date of Registration", "date_reg"),
           ("Name of Deceased", "deceased_name"), ("Sex", "sex"), ("Age", "age"),
           ("Civil Status", "civil_status"), ("Nationality", "nationality"),
           ("Date of Death", "dod"), ("Place of Death", "pod"), ("Cause of Death", "cause")),
    "3A": (("Registry Number", "registry"), ("Date of Registration", "date_reg"),
           ("Date of Marriage", "dom"), ("Place of Marriage", "pom"))
          + tuple((f"{label} ({shown.upper()})", f"{shown}{suffix}")
                  for label, suffix in (("Name", "_name"), ("Age", "_age"), ("Nationality", "_nat"),
                                        ("Name of Mother", "_mother"),
                                        ("Nationality of Mother", "_mother_nat"),
                                        ("Name of Father", "_father"),
                                        ("Nationality of Father", "_father_nat"))
                  for shown in ("husband", "wife")),
}
# Title and opening word of each certificate.
REPORT_TITLES = {"1A": ("Birth available", "birth", "Births"),
                 "2A": ("Death available", "death", "Deaths"),
                 "3A": ("Marriage available", "marriage", "Marriages")}
BLANK = "_______________"


def report_lines(pairs: list[tuple[str, str]]) -> str:
    """Expression of the ``label: value`` lines; blank values are underlined."""
    rows = "array(" + ", ".join(f"{sql.text(label + ': ')} || {sql.or_chain(value, default=BLANK)}"
                                for label, value in pairs) + ")"
    return f"array_join({rows}, {sql.text(chr(10))})"


def certificate(fields: str, hint: str) -> str:
    """Expression of the printable certificate of a stored field map."""
    shown = screen_fields(fields, hint)
    prefix = {"1A": "f1a", "2A": "f2a"}.get(hint, "f3a")
    body = report_lines([(label, shown[f"{prefix}_{s}"]) for label, s in REPORT_LINES[hint]])
    note, fact, register = REPORT_TITLES[hint]
    head = (f"LCR Form No. {hint} ({note})\nTO WHOM IT MAY CONCERN:\n"
            f"We certify that, among others, the following facts of {fact} appear in our "
            f"Registry of {register} of this office:\n")
    issued = sql.or_chain(shown[f"{prefix}_issued_to"], default=BLANK)
    return (f"{sql.text(head)} || {body} || {sql.text(chr(10) + 'This certification is issued to ')} "
            f"|| {issued} || ' upon his/her request.'")


def preview_title(fields: str, hint: str) -> str:
    """Expression of the preview heading: form number and the person or couple."""
    r = sql.key_of(fields)

    def name(*parts: str) -> str:
        return sql.record_name(*[r(p) for p in parts])

    who = {
        "1A": [name("child_first", "child_middle", "child_last")],
        "2A": [name("deceased_first", "deceased_middle", "deceased_last")],
        "3A": [name("husband_first", "husband_last"), name("wife_first", "wife_last")],
        "90": [name("groom_first", "groom_middle", "groom_last"),
               name("bride_first", "bride_middle", "bride_last")],
    }[hint]
    return f"{sql.text(f'Form {hint} — ')} || " + " || ' & ' || ".join(who)
