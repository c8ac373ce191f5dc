"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become tokens: words in lower case, and slots, which are numbers, names (any word of a capital and a small letter,
whatever stands before it) and units (a unit word after a number). A template replaces each slot by its type. Windows of WINDOW
template tokens are hash-joined with the windows of all benchmark items. Hits on one diagonal (same distance between
document and item place) are an aligned passage; its slots must be consistent: on a diagonal a value of the item stands for one
value of the document and that for no other value of the item, so that a question with other numbers or names is found, while chance
fillings of a shared template are not. A window with a slot whose value has two counterparts doesn't count; the others of the passage do. Next to it windows of plain tokens, words and numbers in lower case without slots, are
joined alike, so a copy word by word counts in any case and layout. A pair is a leak if consistent passages of either kind cover at least
COVERAGE of the item's template windows, or of its plain ones.

The benchmark's windows are broadcast only if their count is at most BROADCAST; else both sides are shuffled by
window. Documents are exploded to windows next to the scan and only hits move. Values of slots are looked up for
hits on windows with slots alone.

Edge cases: null and empty texts have no windows and never leak; so have items and documents of fewer than WINDOW
tokens, and template windows with fewer than LITERALS words of their own never count (plain windows always do). A repeated row gives the same pairs once
per distinct (doc_id, text); a null doc_id gives pairs with a null doc_id. Repeated items each give their pairs. A text of any length is
cut into tokens as a whole and its windows are rows. Extra columns are not read; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table, text_key

WINDOW, LITERALS, COVERAGE, BROADCAST = 8, 4, 0.5, 200_000
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi mile miles ft foot feet inch inches yard yards metre metres meter meters "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years l ml litre litres liter liters "
    "gallon gallons degree degrees percent dollar dollars euro euros pound pounds cent cents kmh mph watt watts volt volts"
).split()


def _tokens(text: Column) -> Column:
    """Words and slots in order; a name carries the mark NAME in front."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<![\p{L}\p{M}\p{N}])\p{Lu}(?=\p{Ll})", NAME + "$0")
    return F.regexp_extract_all(F.lower(marked), F.lit(rf"[0-9]+(?:[.,:/][0-9]+)*|{NAME}?\p{{L}}[\p{{L}}\p{{M}}\p{{N}}]*"), F.lit(0))


def _is_number(token: Column) -> Column:
    return (token >= "0") & (token < ":")


def _kind(tokens: Column, token: Column, i: Column) -> Column:
    """The template's token: the slot's type, or the word itself."""
    unit = token.isin(*UNITS) & (i > 0) & _is_number(F.get(tokens, i - 1))
    plain = (token > ":") & ~token.isin(*UNITS)  # by far the most, so asked first
    return F.when(plain, token).when(token < "\x02", F.lit(NAME)).when(_is_number(token), F.lit(NUMBER)).when(unit, F.lit(UNIT)).otherwise(token)


def _plain(token: Column) -> Column:
    return F.ltrim(token, F.lit(NAME))


def _windows(tokens: DataFrame, place: str) -> DataFrame:
    """Two rows for each place that WINDOW tokens start at, with the hash of the template's tokens and, if `plain`, of the plain ones; the
    other columns of tokens stay.

    The hashes of single tokens are array columns; windows are made from them row by row, behind the explode, where
    they are compiled code and feed the join without being stored.
    """
    hashes = tokens.withColumn("_h", F.transform("tokens", lambda x, i: F.xxhash64(_kind(F.col("tokens"), x, i))))
    hashes = hashes.withColumn("_p", F.transform("tokens", lambda x: F.xxhash64(_plain(x))))
    starts = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW))
    rows = hashes.select("*", F.explode(starts).alias(place))
    typed = F.xxhash64(*(F.get("_h", F.col(place) + k) for k in range(WINDOW)))
    plain = F.xxhash64(F.lit("plain"), *(F.get("_p", F.col(place) + k) for k in range(WINDOW)))
    rows = rows.select("*", typed.alias("_t"), plain.alias("_w")).drop("_h", "_p")
    both = F.array(F.struct(F.lit(False).alias("plain"), F.col("_t").alias("window")), F.struct(F.lit(True).alias("plain"), F.col("_w").alias("window")))
    return rows.select("*", F.inline(both)).drop("_t", "_w")


def _slots(tokens: Column, start: Column) -> Column:
    """The values of the slots in the window that starts at `start`, in order."""
    places = F.sequence(start, start + WINDOW - 1)
    kind = lambda i: _kind(tokens, F.get(tokens, i), i)
    return F.transform(F.filter(places, lambda i: kind(i) < "\x04"), lambda i: F.get(tokens, i))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, plain, window, item_pos, slots, n_windows, n_plain): each plain window of each item, and each of the template with enough words of its own."""
    items = benchmark.select("item_id", "text").distinct().select(F.struct("item_id", "text").alias("_i"), _tokens(F.col("text")).alias("tokens"))
    items = _windows(items, "item_pos").select(F.xxhash64("_i.item_id", "_i.text").alias("item"), F.col("_i.item_id").alias("item_id"), "tokens", "item_pos", "plain", "window")
    rows = items.withColumn("slots", F.when(F.col("plain"), F.array().cast("array<string>")).otherwise(_slots(F.col("tokens"), F.col("item_pos")))).filter(WINDOW - F.size("slots") >= LITERALS).drop("tokens")
    sizes = rows.groupBy("item").agg(F.count_if(~F.col("plain")).alias("n_windows"), F.count_if("plain").alias("n_plain")).withColumnRenamed("item", "_item")
    return rows.join(sizes, F.col("item") == F.col("_item")).drop("_item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, tkey, item_id, matched, n_windows, verbatim) for each leak of an item into a row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text", text_key(F.col("text")).alias("tkey"))
    known = cut(benchmark_windows(benchmark), "benchmark-windows")
    n, with_slots = known.agg(F.count("*"), F.coalesce(F.sum((F.size("slots") > 0).cast("int")), F.lit(0))).first()
    small = known.select("window", "plain", "item", "item_pos", (F.size("slots") > 0).alias("slotted"))
    tokens = docs.select("doc_id", "tkey", _tokens(F.col("text")).alias("tokens"))
    rows = _windows(tokens, "doc_pos").select("doc_id", "tkey", "doc_pos", "plain", "window")
    hits = rows.join(F.broadcast(small) if n <= BROADCAST else small, ["window", "plain"]).select("doc_id", "tkey", "doc_pos", "plain", "item", "item_pos", "slotted")
    hits = cut(hits.distinct(), "leak-hits")
    found = hits.filter("not slotted").select("doc_id", "tkey", "item", "plain", F.lit(True).alias("same"), F.col("item_pos").alias("place"))
    if with_slots:
        slotted = hits.filter("slotted")
        want = slotted.groupBy(F.col("doc_id").alias("w_id"), F.col("tkey").alias("w_key")).agg(F.collect_set("doc_pos").alias("at"))
        texts = docs.join(want, F.col("tkey").eqNullSafe(F.col("w_key")) & F.col("doc_id").eqNullSafe(F.col("w_id"))).select("w_id", "w_key", "at", _tokens(F.col("text")).alias("tokens"))
        values = texts.select("w_id", "w_key", F.explode(F.transform("at", lambda p: F.struct(p.alias("p"), _slots(F.col("tokens"), p).alias("own")))).alias("v"))
        values = values.select("w_id", "w_key", F.col("v.p").alias("w_pos"), F.col("v.own").alias("own")).distinct()
        pairs = slotted.join(values, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tkey") == F.col("w_key")) & (F.col("doc_pos") == F.col("w_pos")))
        pairs = pairs.join(known.filter(~F.col("plain")).select(F.col("item").alias("k_item"), F.col("item_pos").alias("k_pos"), "slots"), (F.col("item") == F.col("k_item")) & (F.col("item_pos") == F.col("k_pos")))
        pairs = pairs.select("doc_id", "tkey", "item", (F.col("doc_pos") - F.col("item_pos")).alias("diagonal"), "item_pos", F.explode(F.arrays_zip("slots", "own")).alias("s"))
        pairs = pairs.select("doc_id", "tkey", "item", "diagonal", "item_pos", F.col("s.slots").alias("value"), F.col("s.own").alias("own"))
        there, back = (Window.partitionBy("doc_id", "tkey", "item", "diagonal", c) for c in ("value", "own"))
        odd = (F.min("own").over(there) != F.max("own").over(there)) | (F.min("value").over(back) != F.max("value").over(back))
        judged = pairs.withColumn("odd", odd).groupBy("doc_id", "tkey", "item", "diagonal", "item_pos").agg(F.bool_or("odd").alias("odd"), F.bool_and(F.col("own") == F.col("value")).alias("same"))
        found = found.union(judged.filter("not odd").select("doc_id", "tkey", "item", F.lit(False).alias("plain"), "same", F.col("item_pos").alias("place")))
    places = found.groupBy("doc_id", "tkey", "item", "place").agg(F.bool_or(F.col("plain") | F.col("same")).alias("same"))
    typed = known.filter(~F.col("plain")).select(F.col("item").alias("t_item"), F.col("item_pos").alias("t_pos"))
    typed = F.broadcast(typed) if n <= BROADCAST else typed
    places = places.join(typed, (F.col("item") == F.col("t_item")) & (F.col("place") == F.col("t_pos")), "left")
    # a plain window counts for the template's window at its place too
    covered = places.groupBy("doc_id", "tkey", "item").agg(F.count("t_pos").alias("matched"), F.count("*").alias("all_matched"), F.bool_and("same").alias("verbatim"))
    sizes = known.select("item", "item_id", "n_windows", "n_plain").distinct()
    found = covered.join(F.broadcast(sizes) if n <= BROADCAST else sizes, "item")
    by_type = (F.col("n_windows") > 0) & (F.col("matched") >= F.col("n_windows") * coverage)
    found = found.withColumn("_typed", by_type).filter(F.col("_typed") | (F.col("all_matched") >= F.col("n_plain") * coverage))
    # counted over the template's windows, or over all where these alone do not show the leak
    either = lambda a, b: F.when(F.col("_typed"), F.col(a)).otherwise(F.col(b)).alias(a)
    return found.select("doc_id", "tkey", "item_id", either("matched", "all_matched"), either("n_windows", "n_plain"), "verbatim")


def op4_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tkey")


QUERIES = {"op4_template_decontamination": op4_template_decontamination}
SQL: dict[str, str] = {}
