"""Secret scans by character Markov models, DataFrame functions only (operator 10).

Base spans come from three fixed patterns. The method adds spans: runs of 20 or more token characters
are scored by the log-likelihood ratio of two first-order Markov models over the 64 characters
A-Z a-z 0-9 + / (with _ and - read as those two), one of random strings and one of ordinary identifiers.
Base spans are cut out of a run first, and each part of 20 or more characters is a run of its own. A run is added
where its ratio per transition exceeds `threshold`. Sums over long runs are taken PIECE transitions at a time.

Both models are trained from labelled samples of the table itself: random are the values that the base
patterns found, ordinary are words of eight or more token characters outside base spans. Up to SAMPLE_DOCS
texts (those with the smallest text hashes) give the ordinary words and up to SAMPLE_DOCS texts with base
spans give the random values; every transition starts from a count of one, and the random model also has
PRIOR evenly spread transitions, so that a table without secrets still has a flat model.

Positions are code points, end exclusive. Java's regular expressions find leftmost non-overlapping
matches; positions are sums of the lengths of the pieces between them.

Defined cases: null and empty texts have no spans and the digest of the empty string; repeated rows give
repeated results; an empty table gives an empty result; digest ignores other columns, redact keeps them, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, merged_spans

#: Fixed patterns of the base scan.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: What any assign match contains in lower case.
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")
RUN = r"[A-Za-z0-9+/_-]{20,}"
WORD = r"[A-Za-z0-9+/_-]{8,}"
KINDS = ("assign", "access", "hex", "markov")
SAMPLE_DOCS = 2000
PRIOR = 20_000
THRESHOLD = 0.1
SHORTEST = 20  # as in RUN
PIECE = 65_536
#: Matches whose places are summed up at a time, so that a text with very many is not copied for each.
GROUP = 256
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

SPAN = "array<struct<s:int,kind:int,e:int>>"


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """Arrays of the matches and of the pieces around them (one more piece than matches)."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _spans(matches: Column, pieces: Column, kind: int) -> Column:
    """Array of (s, kind, e) from the matches and the pieces between them."""
    both = F.arrays_zip(matches.alias("m"), pieces.alias("p"))
    length = lambda x: F.coalesce(F.length(x["p"]), F.lit(0)) + F.coalesce(F.length(x["m"]), F.lit(0))
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / GROUP).cast("int")), lambda g: F.slice(both, g * GROUP + 1, F.lit(GROUP)))
    start = F.aggregate(
        groups, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, g: F.struct((acc["at"] + F.aggregate(g, F.lit(0), lambda n, x: n + length(x))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"],
    )
    spans = F.transform(F.arrays_zip(groups.alias("g"), start.alias("at")), lambda z: F.aggregate(
        z["g"], F.struct(z["at"].alias("at"), _none().alias("out")),
        lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.length(x["p"])).alias("s"), F.lit(kind).alias("kind"), (acc["at"] + length(x)).alias("e"),
        )))).alias("out")),
        lambda acc: acc["out"],
    ))
    return F.flatten(spans)


def _none() -> Column:
    return F.array().cast(SPAN)


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind."""
    m, p = _matches(text, ASSIGN)
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    low = F.lower(text)
    hint = F.lit(False)
    for word in ASSIGN_HINTS:
        hint = hint | F.contains(low, F.lit(word))
    assign = F.transform(F.filter(F.arrays_zip(_spans(m, p, 0).alias("x"), values.alias("v")), lambda z: F.length(z["v"]) >= 12), lambda z: z["x"])
    m2, p2 = _matches(text, ACCESS)
    m3, p3 = _matches(text, HEX)
    return {
        "assign": F.when(hint, assign).otherwise(_none()),
        "access": F.when(F.contains(text, F.lit("AKIA")), _spans(m2, p2, 1)).otherwise(_none()),
        "hex": F.when(text.rlike(HEX), _spans(m3, p3, 2)).otherwise(_none()),
    }


def render(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _transitions(value: Column) -> Column:
    """Array of 64 * code + next code over the value's neighbouring characters."""
    codes = F.transform(F.split(F.translate(value, "-_", "+/"), ""), lambda c: F.element_at(_code_table(), F.ascii(c) + 1))
    return F.transform(F.filter(F.arrays_zip(F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))).alias("a"), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(1))).alias("b")), lambda z: (z["a"] >= 0) & (z["b"] >= 0)), lambda z: z["a"] * 64 + z["b"])


def _pieces(text: Column, s: Column, e: Column) -> Column:
    """Array of the strings whose transitions are those of text from s to e: each begins with the last character of the one before."""
    many = F.floor(F.greatest(e - s - 2, F.lit(0)) / PIECE).cast("int")
    return F.transform(F.sequence(F.lit(0), many), lambda i: F.substring(text, s + i * PIECE + 1, F.least(F.lit(PIECE + 1), e - s - i * PIECE)))


def _outside(x: Column, known: Column) -> Column:
    """Array of the parts of span x outside the known spans, as far as they are long enough for a run."""
    inside = F.filter(known, lambda k: (k["s"] < x["e"]) & (x["s"] < k["e"]))
    part = lambda a, b: F.when(b - a >= SHORTEST, F.array(F.struct(a.cast("int").alias("s"), F.lit(3).alias("kind"), b.cast("int").alias("e")))).otherwise(_none())
    parts = F.aggregate(
        F.array_sort(inside), F.struct(x["s"].alias("at"), _none().alias("out")),
        lambda acc, k: F.struct(F.greatest(acc["at"], k["e"]).alias("at"), F.concat(acc["out"], part(acc["at"], k["s"])).alias("out")),
        lambda acc: F.concat(acc["out"], part(acc["at"], x["e"])),
    )
    return F.when(F.exists(known, lambda k: (k["s"] < x["e"]) & (x["s"] < k["e"])), parts).otherwise(F.array(x))


def _code_table() -> Column:
    """128 codes by ASCII value; -1 for all that is not a token character."""
    return F.lit([SYMBOLS.find(chr(i)) if i else -1 for i in range(128)])


class Models:
    """Two tables of 64 x 64 log10 transition probabilities; `ratio` is their difference."""

    def __init__(self, random: dict[int, int], ordinary: dict[int, int]):
        self.random, self.ordinary = self._logs(random, PRIOR / 4096), self._logs(ordinary, 0.0)
        self.ratio = [x - y for x, y in zip(self.random, self.ordinary, strict=True)]

    @staticmethod
    def _logs(counts: dict[int, int], flat: float) -> list[float]:
        out = []
        for a in range(64):
            row = [counts.get(64 * a + b, 0) + 1.0 + flat for b in range(64)]
            total = sum(row)
            out += [math.log10(x / total) for x in row]
        return out


def train(docs: DataFrame) -> Models:
    """Models from the labelled samples of docs(text); at most two tables of 4096 counts reach the driver."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    low, hint = F.lower("text"), F.lit(False)
    for word in ASSIGN_HINTS:
        hint = hint | F.contains(low, F.lit(word))

    def sample(some: DataFrame) -> DataFrame:
        """One row for each of the SAMPLE_DOCS texts with the smallest hashes: only hashes are sorted."""
        last = some.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
        return some.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.first("text").alias("text"))

    def counts(values: DataFrame) -> dict[int, int]:
        pieces = values.select(F.explode(_pieces(F.col("v"), F.lit(0), F.length("v"))).alias("v"))
        found = pieces.select(F.explode(_transitions(F.col("v"))).alias("t")).groupBy("t").count()
        return {r["t"]: r["count"] for r in found.collect()}

    words = sample(rows).select(F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("v"), F.lit(True)).where(~F.col("v").rlike(HEX) & ~F.col("v").rlike(ACCESS))
    words = words.where(~F.col("v").rlike("[0-9]") | (F.length("v") < 16))
    held = sample(rows.where(hint | F.contains("text", F.lit("AKIA")) | F.col("text").rlike(HEX)))
    values = held.select(F.explode(F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12),
        F.regexp_extract_all("text", F.lit("AKIA([A-Z0-9]{14,})"), F.lit(1)),
        F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )).alias("v"))
    return Models(counts(values), counts(words))


def scan(docs: DataFrame, models: Models | None = None, threshold: float = THRESHOLD) -> tuple[DataFrame, str]:
    """docs with a struct of assign, access, hex and markov, arrays of (s, kind, e), and the new column's name; docs needs text."""
    models = models or train(docs)
    text, name = F.coalesce(F.col("text"), F.lit("")), fresh(docs, "secrets")
    base = F.struct(*[c.alias(k) for k, c in base_spans(text).items()])
    m, p = _matches(text, RUN)
    rows = docs.withColumn(name, base)
    runs = fresh(rows, "runs")
    rows = rows.withColumn(runs, F.when(text.rlike(RUN), _spans(m, p, 3)).otherwise(_none()))
    known = F.concat(*[F.col(name)[k] for k in KINDS[:3]])
    ratio = F.lit(models.ratio)

    def scored(x: Column) -> Column:
        total = F.aggregate(
            _pieces(text, x["s"], x["e"]), F.lit(0.0),
            lambda acc, v: acc + F.aggregate(_transitions(v), F.lit(0.0), lambda sum_, t: sum_ + F.element_at(ratio, t + 1)),
        )
        return total > threshold * (x["e"] - x["s"] - 1)

    parts = F.flatten(F.transform(F.col(runs), lambda x: _outside(x, known)))
    markov = F.when(F.size(F.col(runs)) > 0, F.filter(parts, scored)).otherwise(_none())
    return rows.withColumn(name, F.col(name).withField("markov", markov)).drop(runs), name


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of docs(doc_id, text)."""
    rows, name = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    kinds = [F.col(name)[k] for k in KINDS]
    return rows.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in zip(KINDS[:3], kinds[:3], strict=True)],
        F.sha2(render(F.concat(*kinds[:3])), 256).alias("base_sha256"), render(F.concat(*kinds)).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by `mark` (spans that overlap or touch by one) and n_chars, if there, counted anew."""
    rows, name = scan(docs)
    text, spans = F.col("text"), fresh(rows, "spans")
    found = F.transform(F.concat(*[F.col(name)[k] for k in KINDS]), lambda x: F.struct(x["s"].alias("a"), x["e"].alias("b")))
    rows = rows.withColumn(spans, merged_spans(found))
    n = F.size(F.col(spans))
    kept = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        text, F.coalesce(F.get(F.col(spans), i - 1)["b"], F.lit(0)) + 1, F.coalesce(F.get(F.col(spans), i)["a"], F.length(text)) - F.coalesce(F.get(F.col(spans), i - 1)["b"], F.lit(0))))
    out = rows.withColumn("text", F.when(n > 0, F.array_join(kept, mark)).otherwise(text)).drop(name, spans)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
