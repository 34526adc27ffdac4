"""Secrets in texts: patterns for known forms, character Markov models for the rest.

Known forms are assignments to a secret's name, access keys and long hexadecimal numbers. What they
miss is sought among the long runs of key characters: a model of random strings and a model of
ordinary identifiers, both Markov chains over characters, give each run a log-likelihood ratio per
character, and runs above a threshold are spans of kind ``random``.

The models are counts of character transitions in labelled samples, taken by Spark. Samples that
the corpus labels itself are the values of known forms (random) and the runs outside them
(ordinary); a bounded, seeded set of random strings over the usual alphabets covers formats that
the corpus lacks. Only documents of the sample are read for training; every document is scanned.
The threshold is the least that lets at most ``alarms`` of the ordinary samples that were not
trained on pass, and never below ``least_ratio``.

Positions are code points. Texts are searched in slices; a text is given to the slow patterns only
if a linear-time test of the same pattern finds a match in it.

Defined results: a null or empty text has no span; repeated rows are scanned each; rows with
a null ``doc_id`` are scanned but give no samples; a corpus without a known form still has the
generated samples; without ordinary runs the threshold is
``least_ratio``. A ``random`` run that touches a known span is dropped. Documents may carry any
columns; a column named ``secrets`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm import textblock as tb
from scanloom.session import cut


@dataclass(frozen=True)
class SecretParams:
    min_chars: int = 20  # of a run that the models judge
    sample_docs: int = 4000  # documents that samples are taken from
    generated: int = 2000  # random strings per alphabet
    alarms: float = 0.0002  # share of held-out ordinary runs above the threshold
    least_ratio: float = 1.5  # per character, in nats
    prior: float = 0.5  # added to every transition count


#: Fixed forms; letters of the first are read in either case.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
_FORMS = (
    ("assign", re.compile(ASSIGN, re.ASCII | re.IGNORECASE), lambda m: len(m.group(2)) >= 6, "(?i)" + ASSIGN.replace("]+)", "]{6,})")),
    ("access", re.compile(ACCESS), lambda m: m.end() - m.start() >= 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", re.compile(HEX), lambda m: m.end() - m.start() >= 24, r"[0-9a-f]{24}"),
)
#: Alphabets of generated samples.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "capital_hex": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url_base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
_BREAKS = np.ones(256, bool)
_BREAKS[[ord(c) for c in _CHARS]] = False
_CODE = np.zeros(256, np.int64)  # 0 is the start of a run
_CODE[[ord(c) for c in _CHARS]] = np.arange(1, len(_CHARS) + 1)
_N = len(_CHARS) + 1
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, by start and kind."""
    found = [(m.start(), k, m.end()) for k, (_, pattern, valid, _) in enumerate(_FORMS) for m in pattern.finditer(text) if valid(m)]
    return sorted(found)


def _suspects(texts: pa.Array) -> np.ndarray:
    """Texts that hold a valid match of some form, by linear-time tests."""
    hit = [np.asarray(pc.match_substring_regex(texts, gate).fill_null(False)) for *_, gate in _FORMS]
    return np.flatnonzero(hit[0] | hit[1] | hit[2])


@dataclass
class Model:
    """ratio[a, b, c]: log-likelihood ratio of character c after a, b."""

    ratio: np.ndarray
    threshold: float

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mean ratio per character of data[start:end]."""
        size = end - start
        which = np.repeat(np.arange(len(start)), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        place = start[which] + at
        code = _CODE[data]
        one = np.where(at >= 1, code[place - 1], 0)
        two = np.where(at >= 2, code[place - 2], 0)
        return np.bincount(which, weights=self.ratio[two, one, code[place]], minlength=len(start)) / np.maximum(size, 1)


def _runs(texts: tb.Texts, least: int) -> tb.Words:
    """Runs of key characters with a letter, of ``least`` characters or more."""
    runs = tb.words_of(texts, _BREAKS)
    total = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(_LETTER[texts.data], out=total[1:])
    keep = (runs.end - runs.start >= least) & (total[runs.end] > total[runs.start])
    text = runs.text[keep]
    return tb.Words(runs.start[keep], runs.end[keep], text, np.searchsorted(text, np.arange(len(texts) + 1)))


def corpus_samples(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """(token, label): 1 for values of known forms, 0 for other runs, from the sampled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, labels = [], []
            suspects = set(_suspects(batch.column("text")).tolist())
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                hidden, last = [], 0
                for start, kind, end in known_spans(text) if i in suspects else ():
                    value = _FORMS[0][1].match(text[start:end]).group(2) if kind == 0 else text[start:end]
                    tokens.append(value)
                    labels.append(1)
                    if start >= last:
                        hidden.append(text[last:start])
                    last = max(last, end)
                rest = "\n".join([*hidden, text[last:]])
                plain = tb.texts_of(pa.array([rest], pa.string()))
                words = _runs(plain, 4)
                raw = plain.data.tobytes()
                seen = dict.fromkeys(raw[a:b].decode() for a, b in zip(words.start, words.end, strict=True))
                tokens += seen
                labels += [0] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(labels, pa.int32())], ["token", "label"])

    ids = docs.select(F.col("doc_id").alias("id")).filter(F.col("id").isNotNull()).orderBy(F.xxhash64("id"), "id").limit(params.sample_docs)
    chosen = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi")  # at most ``sample_docs`` ids
    return chosen.select("text").mapInArrow(run, "token string, label int").distinct()


def generated_samples(spark: SparkSession, params: SecretParams = SecretParams()) -> DataFrame:
    """(token, label): seeded random strings of 20 to 64 characters over each alphabet, all with label 1."""
    ids = spark.range(params.generated)
    noise = F.concat(*[F.sha2(F.concat_ws(":", F.lit(f"{k}"), "name", F.col("id").cast("string")).cast("binary"), 512) for k in range(2)])
    size = 20 + F.pmod(F.xxhash64("name", "id"), F.lit(45))
    bytes_ = F.transform(F.sequence(F.lit(1), size), lambda i: F.conv(F.substring(noise, (4 * i - 3).cast("int"), F.lit(4)), 16, 10).cast("int"))
    names = F.explode(F.create_map(*[F.lit(x) for pair in ALPHABETS.items() for x in pair])).alias("name", "alphabet")
    return ids.select("id", names).select(F.array_join(F.transform(bytes_, lambda b: F.substring("alphabet", (1 + b % F.length("alphabet")).cast("int"), F.lit(1))), "").alias("token"), F.lit(1).alias("label"))


def joined_samples(samples: DataFrame) -> DataFrame:
    """Ordinary identifiers of several words, made of the ordinary runs: snake, kebab and camel case, paths, numbered names."""
    plain = samples.filter("label = 0").select("token", F.xxhash64("token").alias("h"))
    group = plain.withColumn("g", F.floor(F.pmod("h", F.lit(1 << 20)) / 3)).groupBy("g").agg(F.slice(F.array_sort(F.collect_set("token")), 1, 4).alias("w")).filter(F.size("w") > 1)
    camel = F.array_join(F.transform("w", lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000))), "")
    forms = [F.array_join("w", s) for s in ("_", "-", "/")] + [camel, F.concat(F.array_join("w", "_"), F.lit("_"), (F.col("g") % 1000).cast("string"))]
    return group.select(F.explode(F.array(*forms)).alias("token"), F.lit(0).alias("label"))


def learn(samples: DataFrame, params: SecretParams = SecretParams()) -> Model:
    """Both chains from labelled (token, label); at most 67 ** 3 * 2 counts come to the driver."""
    clean = samples.filter(F.col("token").rlike(f"^[{re.escape(_CHARS)}]+$") & F.col("label").isin(0, 1)).withColumn("part", F.pmod(F.xxhash64("token"), F.lit(4)))
    c = F.concat(F.lit("  "), "token")
    grams = clean.filter("part > 0").select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.substring(c, i.cast("int"), F.lit(3)))).alias("gram"))
    counts = np.full((2, _N, _N, _N), 0.0)
    for row in grams.groupBy("label", "gram").count().toArrow().to_pylist():
        counts[row["label"]][tuple(0 if x == " " else _CODE[ord(x)] for x in row["gram"])] = row["count"]
    chains = []
    for n in counts:
        single = (n.sum((0, 1)) + params.prior) / (n.sum() + params.prior * _N)
        pair = (n.sum(0) + params.prior * _N * single) / (n.sum((0, 2))[:, None] + params.prior * _N)  # each order backs off to the one below
        chains.append(np.log((n + params.prior * _N * pair) / (n.sum(2, keepdims=True) + params.prior * _N)))
    model = Model(chains[1] - chains[0], params.least_ratio)
    held = model_scores(clean.filter(f"part = 0 AND label = 0 AND length(token) >= {params.min_chars}").select("token"), model)
    quantile = held.agg(F.percentile("score", F.lit(1.0 - params.alarms)).alias("q")).first().q
    return Model(model.ratio, max(params.least_ratio, quantile or 0.0))


def model_scores(tokens: DataFrame, model: Model) -> DataFrame:
    """(token, score): mean log-likelihood ratio per character."""
    held = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.texts_of(batch.column("token"))
            yield pa.RecordBatch.from_arrays([batch.column("token"), pa.array(held.value.scores(texts.data, texts.offsets[:-1], texts.offsets[1:]))], ["token", "score"])

    return tokens.mapInArrow(run, "token string, score double")


def train(docs: DataFrame, params: SecretParams = SecretParams()) -> Model:
    """The model of a corpus: its own samples, their combinations and the generated ones."""
    own = cut(corpus_samples(docs, params))
    return learn(own.unionByName(generated_samples(docs.sparkSession, params)).unionByName(joined_samples(own)), params)


def _scan(column: pa.Array, model: Model, params: SecretParams) -> list[list[tuple[int, int, int, float]]]:
    """Spans (start, kind, end, score) of every text, by start and kind."""
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in range(len(column))]
    for i in _suspects(column):
        out[i] = [(s, k, e, 1.0) for s, k, e in known_spans(column[int(i)].as_py())]
    for first, texts in tb.slices(tb.texts_of(column)):
        runs = _runs(texts, params.min_chars)
        score = model.scores(texts.data, runs.start, runs.end)
        points = np.zeros(len(texts.data) + 1, np.int64)
        np.cumsum((texts.data & 0xC0) != 0x80, out=points[1:])
        for r in np.flatnonzero(score > model.threshold):
            base = points[texts.offsets[runs.text[r]]]
            start, end = int(points[runs.start[r]] - base), int(points[runs.end[r]] - base)
            spans = out[first + int(runs.text[r])]
            spans.append((start, 3, end, float(score[r])))
    for i, spans in enumerate(out):
        if any(k == 3 for _, k, _, _ in spans):
            spans.sort()
            kept = []
            known = [(s, e) for s, k, e, _ in spans if k < 3]
            starts = np.array([s for s, _ in known])
            ends = np.maximum.accumulate(np.array([e for _, e in known])) if known else np.zeros(0, np.int64)
            for s, k, e, x in spans:
                last = int(np.searchsorted(starts, e)) - 1  # the last known span that begins before the run ends
                if k < 3 or last < 0 or ends[last] <= s:
                    kept.append((s, k, e, x))
            out[i] = kept
    return out


def find_secrets(docs: DataFrame, model: Model, params: SecretParams = SecretParams()) -> DataFrame:
    """``docs`` with ``secrets``: spans (start, kind, end, score) by start and kind; ``kind`` is the place in ``KINDS``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if f.name != "secrets"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = _scan(batch.column("text"), held.value, params)
            found = pa.array([[dict(zip(("start", "kind", "end", "score"), s, strict=True)) for s in row] for row in spans], kind)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], found], [*[f.name for f in fields], "secrets"])

    return docs.select(*[f.name for f in fields]).mapInArrow(run, T.StructType([*fields, T.StructField("secrets", T.ArrayType(_SPAN))]))


def digest(docs: DataFrame, model: Model, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and all spans as text."""
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = find_secrets(docs.select("doc_id", "text"), model, params)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint")
    base = joined(F.filter("secrets", lambda s: s["kind"] < len(BASE)))
    return out.select("doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(BASE)], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, model: Model, params: SecretParams = SecretParams()) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in angle brackets; of overlapping spans the first."""
    found = find_secrets(docs, model, params)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("secrets").to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"<{KINDS[s['kind']]}>"]
                        at = s["end"]
                texts.append("".join([*parts, text[at:]]) if parts else text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if f.name == "text" else batch.column(f.name) for f in schema], [f.name for f in schema])

    return found.mapInArrow(run, schema)
