"""Secret scans by a battery of randomness tests, in DataFrame operations only.

Base spans are the leftmost matches, without overlap, of three patterns: assignments to a name such as password whose value has
8 characters or more, access keys, runs of 32 hexadecimal digits or more. Beside them, runs of 16 characters or more of the alphabets that
keys are written in are tested:

1. The smallest alphabet that holds a run is its encoding (hexadecimal, base32, base36, base62, base64 and its form for addresses).
   Digits alone and letters of one case alone are no encoding: they are numbers and words.
2. Three tests ask whether it is drawn evenly from its alphabet: chi-squared uniformity over as many even bins as the length
   allows, the number of runs above and below the middle, and serial correlation at lag one. Fisher's method joins them;
   a run stays a candidate if their joint p is at least ``least_p``.
3. A short run passes such tests by chance, so false discoveries are controlled by what the corpus looks like: characters
   of all documents are counted by class (digits, capitals, a-f, g-z, signs), and the likelihood ratio of an even draw against such
   characters is an e-value, which grows with the length. In each class of lengths the e-values of all candidates of
   the corpus pass the e-BH rule (Wang and Ramdas 2022) at level ``alpha``, which holds under any dependence. Only sums by length class and
   step of the e-value are gathered.

Positions are code points, ends are exclusive. They are running sums of the lengths of matches and of what lies between,
in blocks, so that a text with many matches costs in proportion.

Defined cases: a null or empty text has no spans; doc_ids may be null or repeated, rows count by themselves; columns in ``keep`` pass
through; texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.tables import saved

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a shorter match holds no longer one
HEX = r"[0-9a-f]{32,}"
_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: Assignments come first, so runs inside them aren't tested.
_TESTED = f"{ASSIGN}|{_RUN}"
KINDS = ("assign", "access", "hex", "random")

#: Encodings: name, characters, alphabet in the order of its values (none: not what keys are written in).
ENCODINGS = (
    ("decimal", "0-9", ""),
    ("hex", "0-9a-f", "0123456789abcdef"),
    ("upper hex", "0-9A-F", "0123456789ABCDEF"),
    ("lower", "a-z", ""),
    ("upper", "A-Z", ""),
    ("base32", "A-Z2-7", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0-9a-z", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "A-Za-z0-9", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "A-Za-z0-9+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "A-Za-z0-9_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Classes of characters that are counted in the corpus, and their sizes.
CLASSES = (("digit", "0-9", 10), ("capital", "A-Z", 26), ("af", "a-f", 6), ("gz", "g-z", 20), ("sign", "+/_-", 4))


@dataclass(frozen=True)
class SecretParams:
    value: int = 8
    least_p: float = 0.01
    alpha: float = 0.05
    #: Lower ends of the classes of lengths.
    lengths: tuple[int, ...] = (16, 24, 32, 64)
    #: Steps of the logarithm of the e-value in a class's counts.
    steps: int = 8
    most_step: int = 4000


_BLOCK = 64
_MARK = "\x01"
_PLACED = "array<struct<start:bigint,end:bigint,found:string,value:string>>"


def _pieces(text: Column, pattern: str) -> Column:
    """What lies before, in, between ... and after the matches of ``pattern``: one pass marks them with a character that
    :func:`scan` has taken from the text."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK, -1)


def _steps(pieces: str, group: bool = False) -> Column:
    """(gap, n, found, value) of each match: the characters before it and in it, what it is, and the group of an assignment."""
    kind = "array<struct<gap:bigint,n:bigint,found:string,value:string>>"
    places = F.sequence(F.lit(0), F.floor(F.size(pieces) / 2).cast("int") - 1)
    rows = F.transform(places, lambda i: F.struct(
        F.length(F.get(pieces, i * 2)).cast("long").alias("gap"), F.length(F.get(pieces, i * 2 + 1)).cast("long").alias("n"), F.get(pieces, i * 2 + 1).alias("found"),
        (F.regexp_extract(F.get(pieces, i * 2 + 1), ASSIGN, 1) if group else F.lit("")).alias("value")))
    return F.when(F.size(pieces) > 1, rows.cast(kind)).otherwise(F.array().cast(kind))


def _blocks(steps: str) -> Column:
    last = F.floor((F.size(steps) - 1) / _BLOCK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))
    return F.when(F.size(steps) > 0, cut)


def _placed(blocks: str) -> Column:
    """(start, end, found, value) of all matches in :func:`_blocks`."""
    zero = F.lit(0).cast("long")
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda acc, x: acc + x["gap"] + x["n"]))
    starts = F.aggregate(totals, F.array(zero), lambda acc, t: F.concat(acc, F.array(F.element_at(acc, -1) + t)))

    def inside(block: Column, start: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["gap"]
            one = F.struct(at.alias("start"), (at + x["n"]).alias("end"), x["found"].alias("found"), x["value"].alias("value"))
            return F.struct((at + x["n"]).alias("at"), F.concat(acc["out"], F.array(one)).cast(_PLACED).alias("out"))

        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(_PLACED).alias("out")), add, lambda acc: acc["out"])

    placed = F.flatten(F.zip_with(blocks, F.slice(starts, F.lit(1), F.size(blocks)), inside))
    return F.coalesce(placed, F.array().cast(_PLACED))


def _case(name: Column, pick) -> Column:
    out = None
    for row in ENCODINGS:
        value = F.lit(pick(row))
        out = F.when(name == row[0], value) if out is None else out.when(name == row[0], value)
    return out


def _encoding(body: Column) -> Column:
    out = None
    for name, characters, _ in ENCODINGS:
        fits = body.rlike(f"^[{characters}]+$")
        out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
    return out


def upper_tail(z: Column) -> Column:
    """Chance of a standard normal number above ``z`` (Abramowitz and Stegun 7.1.26, error below 1e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    half = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z >= 0, half).otherwise(1.0 - half)


def _tests(runs: Column) -> Column:
    """Runs (start, end, found, value) with encoding, size of the alphabet, counts by class and the joint p of the battery."""
    bare = F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.regexp_replace(r["found"], "=+$", "").alias("body")))
    bare = F.filter(bare, lambda r: F.length(r["body"]) >= 16)
    named = F.transform(bare, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["body"].alias("body"), _encoding(r["body"]).alias("encoding")))
    named = F.filter(named, lambda r: r["encoding"].isin(*(e[0] for e in ENCODINGS if e[2])))
    with_values = F.transform(named, lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"), r["encoding"].alias("encoding"), F.length(r["body"]).alias("n"),
        _case(r["encoding"], lambda e: len(e[2])).alias("size"), _values(r["body"], r["encoding"]).alias("v"),
        *(F.length(F.regexp_replace(r["body"], f"[^{c}]", "")).alias(k) for k, c, _ in CLASSES)))
    # an even alphabet has as many values below its middle as above
    counted = F.transform(with_values, lambda r: F.struct(
        *_same(r, "start", "end", "encoding", "n", "size", *(k for k, _, _ in CLASSES)),
        F.greatest(F.lit(2), F.least(r["size"], F.floor(r["n"] / 4).cast("int"))).alias("bins"), r["v"].alias("v"),
        F.zip_with(F.slice(r["v"], F.lit(1), r["n"] - 1), F.slice(r["v"], F.lit(2), r["n"] - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("next")))
    scored = F.transform(counted, lambda r: F.struct(
        *_same(r, "start", "end", "encoding", "n", "size", *(k for k, _, _ in CLASSES)), _chi_squared(r).alias("chi"), (r["bins"] - 1.0).alias("free"),
        F.size(F.filter(r["next"], lambda x: (x["a"] * 2 >= r["size"]) != (x["b"] * 2 >= r["size"]))).alias("turns"), _serial(r).alias("serial")))
    normal = F.transform(scored, lambda r: F.struct(
        *_same(r, "start", "end", "encoding", "n", "size", *(k for k, _, _ in CLASSES)),
        # Wilson and Hilferty's cube root of chi-squared is nearly normal
        ((F.pow(r["chi"] / r["free"], F.lit(1 / 3)) - (1.0 - 2.0 / (9.0 * r["free"]))) / F.sqrt(2.0 / (9.0 * r["free"]))).alias("z_chi"),
        ((r["turns"] - (r["n"] - 1.0) / 2) / F.sqrt((r["n"] - 1.0) / 4)).alias("z_runs"), (r["serial"] * F.sqrt(r["n"] - 1.0)).alias("z_serial")))
    floor = F.lit(1e-12)
    fisher = F.transform(normal, lambda r: F.struct(
        *_same(r, "start", "end", "encoding", "n", "size", *(k for k, _, _ in CLASSES)),
        (-(F.log(F.greatest(upper_tail(r["z_chi"]), floor)) + F.log(F.greatest(2.0 * upper_tail(F.abs(r["z_runs"])), floor))
           + F.log(F.greatest(2.0 * upper_tail(F.abs(r["z_serial"])), floor)))).alias("half")))
    return F.transform(fisher, lambda r: F.struct(
        *_same(r, "start", "end", "encoding", "n", "size", *(k for k, _, _ in CLASSES)),
        # minus twice the sum of logarithms is chi-squared with six degrees of freedom
        (F.exp(-r["half"]) * (1.0 + r["half"] + r["half"] * r["half"] / 2)).alias("p")))


def _same(r: Column, *names: str) -> list[Column]:
    return [r[k].alias(k) for k in names]


def _values(body: Column, encoding: Column) -> Column:
    """Place in the alphabet of each character."""
    alphabet = _case(encoding, lambda e: e[2])
    # the alphabet is chosen once for a run, not for each character
    return F.flatten(F.transform(F.array(alphabet), lambda a: F.transform(F.split(body, ""), lambda c: F.instr(a, c) - 1)))


def _chi_squared(r: Column) -> Column:
    """Of the bins: bin b holds the values from ceil(b * size / bins) on."""
    def part(total: Column, b: Column) -> Column:
        width = F.ceil((b + 1) * r["size"] / r["bins"]) - F.ceil(b * r["size"] / r["bins"])
        seen = F.size(F.filter(r["v"], lambda v: F.floor(v * r["bins"] / r["size"]) == b))
        return total + seen * seen * r["size"] / (r["n"] * width)

    return F.aggregate(F.sequence(F.lit(0), r["bins"] - 1), F.lit(0.0), part) - r["n"]


def _serial(r: Column) -> Column:
    """Correlation of neighbours, about the mean and variance of an even draw."""
    middle, spread = (r["size"] - 1.0) / 2, (r["size"] * r["size"] - 1.0) / 12
    return F.aggregate(r["next"], F.lit(0.0), lambda acc, x: acc + (x["a"] - middle) * (x["b"] - middle)) / spread / (r["n"] - 1.0)


def _length_class(n: Column, p: SecretParams) -> Column:
    out = F.lit(0)
    for k, least in enumerate(p.lengths):
        out = F.when(n >= least, F.lit(k)).otherwise(out)
    return out


def _log_e(r: Column, logs: Column) -> Column:
    """Logarithm of the likelihood ratio of an even draw against the corpus's characters; ``logs`` by class."""
    own = [r[k] * (-F.log(r["size"].cast("double")) - logs[k]) for k, _, _ in CLASSES]
    return sum(own[1:], own[0])


def scan(docs: DataFrame, keep: list[str], p: SecretParams = SecretParams()) -> DataFrame:
    """``keep`` columns of ``docs`` with assign, access, hex (arrays of start, end) and random (array of start, end,
    encoding, n, p, log_e), from the column text."""
    # the mark is in no pattern, so another such character in its place moves nothing
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _MARK, "\x02")
    text = F.when(F.contains(F.col("text"), F.lit(_MARK)), text).otherwise(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(*keep, text.alias("_text"))
    read = F.col("_text")
    assigns, none = read.rlike(ASSIGN), F.array(F.lit(""))
    rows = rows.select(
        *keep, F.when(assigns, _pieces(read, ASSIGN)).otherwise(none).alias("_assign"),
        F.when(F.contains(read, F.lit("AKIA")), _pieces(read, ACCESS)).otherwise(none).alias("_access"),
        F.when(read.rlike(HEX), _pieces(read, HEX)).otherwise(none).alias("_hex"),
        F.when(assigns, _pieces(read, _TESTED)).otherwise(_pieces(read, _RUN)).alias("_random"),
        F.struct(*((F.length(read) - F.length(F.regexp_replace(read, f"[{c}]+", ""))).cast("long").alias(k) for k, c, _ in CLASSES)).alias("_counts"))
    rows = rows.select(*keep, "_counts", _steps("_assign", True).alias("_assign"), _steps("_access").alias("_access"), _steps("_hex").alias("_hex"), _steps("_random", True).alias("_random"))
    names = ("_assign", "_access", "_hex", "_random")
    rows = rows.select(*keep, "_counts", *(_blocks(k).alias(k) for k in names))
    rows = rows.select(*keep, "_counts", *(_placed(k).alias(k) for k in names))
    spans = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    base = F.filter("_assign", lambda x: F.length(x["value"]) >= p.value)
    runs = F.filter("_random", lambda x: (x["value"] == "") & ~x["found"].rlike(f"{ASSIGN}|{ACCESS}|{HEX}"))
    rows = rows.select(
        *keep, "_counts", spans(base).alias("_assign"), spans(F.col("_access")).alias("_access"), spans(F.col("_hex")).alias("_hex"), _tests(runs).alias("_runs"))
    rows = saved(rows, "secret-runs")
    # the corpus by class: one row
    sums = rows.agg(*(F.coalesce(F.sum(f"_counts.{k}"), F.lit(0)).alias(k) for k, _, _ in CLASSES))
    whole = sum((F.col(k) + 1.0 for k, _, _ in CLASSES[1:]), F.col("digit") + 1.0)
    logs = sums.select(F.struct(*(F.log((F.col(k) + 1.0) / whole / n).alias(k) for k, _, n in CLASSES)).alias("_logs"))
    tested = rows.crossJoin(F.broadcast(logs)).withColumn("_runs", F.transform("_runs", lambda r: F.struct(
        *_same(r, "start", "end", "encoding", "n", "p"), _length_class(r["n"], p).alias("class"), _log_e(r, F.col("_logs")).alias("log_e"))))
    step = F.greatest(F.lit(-1), F.least(F.lit(p.most_step), F.floor(F.col("r.log_e") * p.steps))).cast("int")
    counts = tested.select(F.explode("_runs").alias("r")).groupBy(F.col("r.class").alias("class"), step.alias("step")).agg(
        F.count(F.lit(1)).alias("all"), F.sum(F.when(F.col("r.p") >= p.least_p, 1).otherwise(0)).alias("n"))
    # e-BH: the least step at which the k runs at or above it have e-values of at least all / (alpha * k)
    by, down = Window.partitionBy("class"), Window.partitionBy("class").orderBy(F.desc("step"))
    counts = counts.withColumn("k", F.sum("n").over(down)).withColumn("tests", F.sum("all").over(by))
    held = counts.where((F.col("k") > 0) & (F.col("step") / p.steps >= F.log(F.col("tests") / (p.alpha * F.col("k")))))
    bars = held.groupBy("class").agg((F.min("step") / p.steps).alias("bar")).agg(F.map_from_entries(F.collect_list(F.struct("class", "bar"))).alias("_bars"))
    found = F.filter("_runs", lambda r: (r["p"] >= p.least_p) & (r["log_e"] >= F.element_at(F.col("_bars"), r["class"])))
    found = F.transform(found, lambda r: F.struct(*_same(r, "start", "end", "encoding", "n", "p", "log_e")))
    return tested.crossJoin(F.broadcast(bars)).select(
        *keep, F.col("_assign").alias("assign"), F.col("_access").alias("access"), F.col("_hex").alias("hex"), found.alias("random"))


def joined(*kinds: str) -> Column:
    """kind:start:end of the spans of :func:`scan`, by start and then kind as listed, joined by commas."""

    def numbered(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))

    order = F.array_sort(F.concat(*map(numbered, kinds)))
    name = lambda i: F.element_at(F.array(*map(F.lit, KINDS)), i + 1)
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
