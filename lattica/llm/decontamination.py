"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Texts become words of letters and digits. A number, a unit of measure after a number
and a capitalised word (a name) become typed placeholders, the rest is lower-cased:
the template. Windows of ``window`` template words of all documents are hash-joined
with those of the benchmark. Matching windows on one alignment form a span; its
slots are consistent if item and document values of the placeholders map one to one,
so a question asked again with other numbers or names is caught, while a chance
match of placeholders isn't. Windows of the lower-cased words are joined beside the
templates: capitals decide what a name is, so a copy in capitals or in small letters has
other templates than its item, but the same words. A document is contaminated by an item
if its consistent spans hold at least ``share`` percent of the item's windows, as
templates or word for word.

The benchmark's windows are broadcast up to ``broadcast_windows`` (counted first);
larger benchmarks are joined by shuffle. A benchmark window in a third of all
documents is a row for each place, never a pair of documents.

Defined cases: null and empty texts match nothing; texts and items shorter than a
window match nothing; items with equal templates and values count as the one with the
least id; repeated rows count once for each doc_id; rows without a doc_id or item_id
are left out; whole texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import saved

#: Units of measure that are typed as such after a number; fixed values.
UNITS = (
    "kg|g|mg|lb|oz|km|m|cm|mm|mi|ft|in|l|ml|s|sec|min|h|hr|hours?|minutes?|seconds?|days?|weeks?|months?|years?"
    "|meters?|metres?|kilometers?|kilometres?|miles?|feet|inches|liters?|litres?|grams?|kilograms?|pounds?"
    "|dollars?|euros?|cents?|percent|degrees?|usd|eur"
)


@dataclass(frozen=True)
class TemplateParams:
    window: int = 8
    #: Least percentage of an item's windows in a contaminated document.
    share: int = 50
    broadcast_windows: int = 1_000_000


def raw_words(text: Column) -> Column:
    """Words of letters and digits, each between spaces of its own; digits part from letters."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", "  ")
    spaced = F.regexp_replace(spaced, r"(\p{N})(\p{L})", "$1  $2")
    return F.concat(F.lit(" "), F.regexp_replace(spaced, "^ +| +$", ""), F.lit(" "))


def template(raw: Column) -> Column:
    """The same words with #n, #u and #p for numbers, units and names, in lower case."""
    t = F.regexp_replace(raw, r" \p{N}[\p{L}\p{N}]* ", " #n ")
    t = F.regexp_replace(t, rf" #n  (?i:{UNITS}) ", " #n  #u ")
    t = F.regexp_replace(t, r" \p{Lu}\p{Ll}[\p{L}\p{N}]* ", " #p ")
    return F.lower(t)


def words(spaced: Column | str) -> Column:
    """The words of either form; an empty text has one empty word, less than any window."""
    return F.split(F.trim(spaced), "  ")


def _windows(template_words: Column, raw: Column, n: int) -> Column:
    """Hashes of all windows of n words: of each place the template's and then, of another
    kind, that of the words themselves."""
    places = F.when(F.size(template_words) >= n, F.sequence(F.lit(1), F.size(template_words) - (n - 1)))
    return F.flatten(F.transform(places, lambda i: F.array(
        F.xxhash64(F.slice(template_words, i, F.lit(n))), F.xxhash64(F.slice(raw, i, F.lit(n)), F.lit("raw")))))


def _places(texts: DataFrame, n: int, at: str, keep: list[str]) -> DataFrame:
    """One row for each window of (temp, raw): its place, whether it is the words themselves, its hash."""
    found = texts.select(*keep, F.posexplode(_windows(F.col("temp"), F.col("raw"), n)).alias("_pos", "hash"))
    return found.select(*keep, F.shiftright("_pos", 1).alias(at), (F.col("_pos") % 2 == 1).alias("verbatim"), "hash")


def _items(benchmark: DataFrame) -> DataFrame:
    raw = raw_words(F.col("text"))
    items = benchmark.where("item_id is not null").select("item_id", F.lower(raw).alias("low"), template(raw).alias("temp"))
    items = items.groupBy("low", "temp").agg(F.min("item_id").alias("item_id"))
    return items.select("item_id", words("low").alias("raw"), words("temp").alias("temp"))


def contaminated(docs: DataFrame, benchmark: DataFrame, p: TemplateParams = TemplateParams()) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched) of each contaminated document and item."""
    listed = saved(
        _places(_items(benchmark), p.window, "item_at", ["item_id", "raw", "temp"]).withColumnsRenamed({"raw": "item_raw", "temp": "item_words"}), "template-items")
    sizes = listed.where("not verbatim").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_windows"))
    keys = listed.select("hash", "item_id", "item_at")
    if keys.limit(p.broadcast_windows + 1).count() <= p.broadcast_windows:
        keys = F.broadcast(keys)
    raw = raw_words(F.col("text"))
    own = docs.where("doc_id is not null").select("doc_id", words(template(raw)).alias("temp"), words(F.lower(raw)).alias("raw"))
    places = _places(own, p.window, "at", ["doc_id"])
    spans = (
        places.join(keys, "hash").groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
        .agg(
            F.collect_set(F.when(~F.col("verbatim"), F.col("item_at"))).alias("places"),
            F.collect_set(F.when(F.col("verbatim"), F.col("item_at"))).alias("same_places"),
        )
    )
    spans = saved(spans, "template-spans")
    # slot values of the spans, from the texts of the documents that have any
    values = listed.where("item_at = 0 and not verbatim").select("item_id", "item_raw", "item_words")
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    met = spans.join(values, "item_id").join(texts, "doc_id").withColumn("doc_raw", words(F.lower(raw_words(F.col("text")))))
    # written, so that the words are made once for a span and not again for each slot
    met = saved(met.drop("text"), "template-met")

    def consistent(found: Column) -> Column:
        """The places, or none where the slots from the first to the last of them don't map one to one."""
        lo, hi = F.array_min(found), F.array_max(found) + p.window - 1
        pairs = F.transform(
            F.when(F.size(found) > 0, F.sequence(lo, hi)),
            lambda i: F.struct(F.get("item_words", i).alias("kind"), F.get("item_raw", i).alias("mine"), F.get("doc_raw", i + F.col("shift")).alias("theirs")),
        )
        slots = F.array_distinct(F.filter(pairs, lambda x: x["kind"].startswith("#")))
        mine = F.size(F.array_distinct(F.transform(slots, lambda x: F.struct(x["kind"], x["mine"]))))
        theirs = F.size(F.array_distinct(F.transform(slots, lambda x: F.struct(x["kind"], x["theirs"]))))
        return F.when((mine == F.size(slots)) & (theirs == F.size(slots)), found).otherwise(F.array().cast("array<int>"))

    # windows word for word count where they and the templates' windows are consistent together
    both = F.array_union("places", "same_places")
    held = met.select("doc_id", "item_id", F.explode(F.array_union(consistent(F.col("places")), F.array_intersect("same_places", consistent(both)))).alias("at"))
    matched = held.groupBy("doc_id", "item_id").agg(F.count_distinct("at").alias("n_matched"))
    return matched.join(sizes, "item_id").where(F.col("n_matched") * 100 >= F.col("n_windows") * p.share).select(
        "doc_id", "item_id", "n_windows", "n_matched")
