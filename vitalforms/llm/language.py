"""Language identification with a linear-chain conditional random field.

Every word of a text is a position of the chain.  Its features are affixes,
inner letter trigrams and the word itself (the learned lexicon), hashed into
one table of weights per language; transitions between the languages of
neighbouring words are learned as well, from sequences in which stretches of
different languages follow each other.  Forward-backward gives each word the
probability of each language; a document takes the language with the largest
mean.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalforms.llm.common import in_blocks, mix, prefix_hashes, range_hashes

UNKNOWN = "und"
TABLE_BITS = 16
BLOCK = 500_000  # bytes of text scored at once: several tables of words x languages are held for them
STRETCH = 40          # words of one document in a training sequence
STRETCHES = 5000      # of all languages together, what the chain is fitted on
PER_DOCUMENT = 4      # stretches taken from one document at most
LONGEST = 4000        # characters of a stretch that reach the driver
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Chain:
    """Learned weights: per hashed feature and language, per pair of neighbours, and at the start."""

    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << TABLE_BITS, 0), np.float32))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0))


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of every word, index of the first word of every text)."""
    lowered = [t.decode().lower().encode() for t in texts]
    data = np.frombuffer(b"\n".join(lowered) + b"\n", np.uint8)
    firsts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in lowered], out=firsts[1:])
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    edge = np.flatnonzero(np.diff(np.concatenate(([False], letter)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    size = ends - starts
    wide = data.astype(np.uint32)
    last = len(data) - 1

    def letters(at: np.ndarray, n: int, inside: np.ndarray) -> np.ndarray:
        packed = np.zeros(len(at), np.uint32)
        for k in range(n):
            packed = (packed << np.uint32(8)) | wide[np.clip(at + k, 0, last)]
        return np.where(inside, packed, np.uint32(0))

    columns = [letters(starts, n, size >= n) for n in (1, 2, 3)]
    columns += [letters(ends - n, n, size >= n) for n in (1, 2, 3, 4)]
    columns += [letters(starts + k, 3, size >= k + 3) for k in (1, 2)]
    salted = np.stack([(c.astype(np.uint64) << np.uint64(4)) + np.uint64(i) for i, c in enumerate(columns)], axis=1)
    whole = range_hashes(prefix_hashes(data), starts, ends)
    hashed = np.concatenate((mix(salted), whole[:, None]), axis=1) >> np.uint64(64 - TABLE_BITS)
    return hashed.astype(np.int32), np.searchsorted(starts, firsts)


def marginals(scores: np.ndarray, firsts: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all texts side by side: (language probabilities of
    every word, expected count of every transition)."""
    moves, start = np.exp(chain.moves), np.exp(chain.first)
    local = np.exp(scores - scores.max(axis=1, keepdims=True)) + 1e-30
    length = np.diff(firsts)
    order = np.argsort(-length, kind="stable")
    begin, length = firsts[:-1][order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    forward, backward = np.empty_like(local), np.ones_like(local)
    pairs = np.zeros_like(moves)
    state = None
    for t, n in enumerate(active):
        at = begin[:n] + t
        state = local[at] * (start if t == 0 else state[:n] @ moves)
        state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    for t in range(len(active) - 1, 0, -1):
        at = begin[:active[t]] + t
        ahead = local[at] * backward[at]
        behind = ahead @ moves.T
        total = (forward[at - 1] * behind).sum(axis=1, keepdims=True)
        pairs += forward[at - 1].T @ (ahead / total)
        backward[at - 1] = behind / behind.sum(axis=1, keepdims=True)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), pairs * moves


def fit(texts: list[bytes], languages: list[str], sequences: int = 2500, rounds: int = 20) -> Chain:
    """Maximise the likelihood of the labelled words by AdaGrad."""
    names = sorted(set(languages))
    if not names:
        return Chain()
    label = {n: i for i, n in enumerate(names)}
    features, firsts = word_features(texts)
    pieces = [(a, min(a + STRETCH, end), label[lang])
              for begin, end, lang in zip(firsts[:-1], firsts[1:], languages)
              for a in range(begin, end, STRETCH)]
    if not pieces:
        return Chain()
    draw = np.random.default_rng(17).permutation(len(pieces))[:2 * sequences]
    picked = np.concatenate([np.arange(*pieces[i][:2]) for i in draw])
    sizes = np.array([pieces[i][1] - pieces[i][0] for i in draw])
    truth = np.repeat([pieces[i][2] for i in draw], sizes)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.append(bounds[:-1:2], bounds[-1])  # two pieces to a sequence
    x, n = features[picked], len(names)
    inner = np.ones(len(x), bool)
    inner[ends[:-1]] = False
    seen = np.zeros((n, n))
    np.add.at(seen, (truth[:-1][inner[1:]], truth[1:][inner[1:]]), 1)
    chain = Chain(names, np.zeros((1 << TABLE_BITS, n), np.float32), np.zeros((n, n)), np.zeros(n))
    past_w, past_m = np.full(chain.weights.shape, 1e-3, np.float32), np.full((n, n), 1e-3)
    goal = np.eye(n, dtype=np.float32)[truth]
    for _ in range(rounds):
        scores = chain.weights[x].sum(axis=1).astype(np.float64)
        likely, pairs = marginals(scores, ends, chain)
        slope = goal - likely
        step = np.stack([np.bincount(x.ravel(), np.repeat(slope[:, k], x.shape[1]), 1 << TABLE_BITS)
                         for k in range(n)], axis=1).astype(np.float32) - 0.01 * chain.weights
        past_w += step ** 2
        chain.weights += 0.3 * step / np.sqrt(past_w)
        step = seen - pairs - 0.01 * chain.moves
        past_m += step ** 2
        chain.moves += 0.3 * step / np.sqrt(past_m)
    return chain


def training_rows(docs: DataFrame, stretches: int = STRETCHES) -> list[tuple[bytes, str]]:
    """Stretches of at most ``STRETCH`` words from labelled documents outside the held-out quarter, with their languages.

    Each language gives at most ``stretches`` divided by the number of languages (one at least), and each document at
    most ``PER_DOCUMENT``; both are chosen by hash.  A stretch is cut at ``LONGEST`` characters.
    """
    letters = r"A-Za-z\x{80}-\x{10FFFF}"
    known = docs.where(F.col("lang").isNotNull() & ~held_out(docs)).select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = known.where(F.col("text").rlike(f"[{letters}]"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return []
    each, whole = max(1, stretches // len(counts)), 1 << 40
    # twice as many documents as stretches are needed, or all of them, are cut
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, (2 * each + 50) / r["count"]) * whole))])
    few = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(whole)) < share[F.col("lang")])
    words = F.trim(F.regexp_replace("text", f"[^{letters}]+", " "))
    cut = F.regexp_extract_all(words, F.lit(rf"(?:[^\x20]++\x20?+){{1,{STRETCH}}}+"), F.lit(0))
    drawn = F.slice(F.array_sort(F.transform(cut, lambda s, i: F.struct(
        F.xxhash64(F.col("doc_id"), i, s).alias("k"), F.substring(s, 1, LONGEST).alias("s")))), 1, PER_DOCUMENT)
    pieces = few.select("lang", F.explode_outer(drawn).alias("p")).select("lang", "p.k", "p.s").where("s IS NOT NULL")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("k", "s"))
    rows = pieces.withColumn("_n", first).where(F.col("_n") <= each).collect()
    return [(r.s.encode(), r.lang) for r in sorted(rows, key=lambda r: (r.k, r.s, r.lang))]


def held_out(docs: DataFrame):
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, docs["doc_id"].isNull())


def predict(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` (with a text column) and the columns lang_pred and score.

    A text that is null or has no letter is ``und`` with score 0, as is every
    text when nothing was learned.  Empty tables give no rows.
    """
    names, weights = chain.languages, chain.weights
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def work(batch, texts):
        found = [(UNKNOWN, 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if names and _LETTER.search(t.decode())]
        if asked:
            features, firsts = word_features([texts[i] for i in asked])
            scores = np.zeros((len(features), len(names)))
            for k in range(features.shape[1]):
                scores += weights[features[:, k]]
            likely, _ = marginals(scores, firsts, chain)
            means = np.add.reduceat(likely, firsts[:-1]) / np.diff(firsts)[:, None]
            for i, m in zip(asked, means):
                found[i] = names[int(m.argmax())], float(min(1.0, max(0.0, m.max())))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(lambda batches: in_blocks(batches, work, size=BLOCK), schema)


def identify(docs: DataFrame, stretches: int = STRETCHES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row.

    The chain is fitted on at most ``stretches`` stretches of 40 words (a bound
    on what the driver holds), shared evenly among the languages and at most
    ``PER_DOCUMENT`` of a document, from labelled documents whose
    crc32(doc_id) modulo 4 is not 2; language,
    source and id never reach a prediction.  A null doc_id counts as held
    out.  Repeated rows are predicted each; extra columns are ignored.
    """
    rows = training_rows(docs, stretches)
    chain = fit([t for t, _ in rows], [lang for _, lang in rows])
    slim = docs.select("doc_id", held_out(docs).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(slim, chain).select("doc_id", "held_out", "lang_pred", "score")
