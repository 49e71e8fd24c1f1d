"""Names of a catalog found in texts, and what is left of a text without them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import COLLECTOR, EDGE, VARIANT_TOKENS, ascii_edges
from ..session import materialised

#: Sets that one pass over the texts looks for; a longer catalog takes as many passes as it has of these.
PASS_SETS = 200_000
# Words of languages, which are no names.
LANGUAGE_WORDS = r"(?i)\b(japanese|english|chinese|simplified|traditional|jp|ja|en)\b"
LANGUAGE_SIGNS = "日本語|简体|简中|繁体"


def _finder(patterns: Sequence[tuple[int, str]]):
    """mapInArrow function: row, and the numbers of the patterns that its text holds, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_text: dict[str, list[int]] = {}
        for number, text in patterns:
            by_text.setdefault(text, []).append(number)
        automaton = ahocorasick.Automaton()
        for text, numbers in by_text.items():
            automaton.add_word(text, numbers)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({n for _, numbers in automaton.iter(text) for n in numbers}) if text and by_text else [] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["_row", "numbers"])

    return run


def sets_in_texts(texts: DataFrame, sets: DataFrame, pass_sets: int = PASS_SETS) -> DataFrame:
    """texts (with text) with sets: the sets (place, set_key, name) whose name or key stands in the text, in order of place.

    Letter case doesn't count, nor do the words' ends. The catalog's names are the patterns of one automaton that goes through each
    text once, however many there are; it is sent to the tasks, pass_sets sets at a time, so that no more than those
    must fit: a longer catalog is looked for in as many passes over the texts. place is each set's own number."""
    held = texts.select(F.struct(*texts.columns).alias("_row"), F.lower("text").alias("_text"))
    kind = held.schema["_row"].dataType.simpleString()
    last = sets.agg(F.count("*").alias("n")).first()["n"]
    ordered = materialised(sets.select("place", "set_key", "name"))
    bounds = [r["place"] for r in _every(ordered, pass_sets, last)]
    found = None
    for i, low in enumerate(bounds):
        own = ordered.where(F.col("place") >= low)
        own = own.where(F.col("place") < bounds[i + 1]) if i + 1 < len(bounds) else own
        patterns = [(r["place"], p) for r in own.collect() for p in {(r["name"] or "").lower(), r["set_key"] or ""} if p]
        part = held.mapInArrow(_finder(patterns), f"_row {kind}, numbers array<bigint>")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return texts.withColumn("sets", F.array().cast("array<struct<place:bigint,set_key:string,name:string>>"))
    if len(bounds) > 1:
        found = found.groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"), F.count("*").alias("_n"))
        found = found.select("_row", "numbers", F.explode(F.array_repeat(F.lit(0), (F.col("_n") / len(bounds)).cast("int"))).alias("_copy")).drop("_copy")
    met = found.where(F.size("numbers") > 0).select("_row", "numbers", F.monotonically_increasing_id().alias("_id"))
    met = materialised(met)
    named = met.select("_id", F.explode("numbers").alias("place")).join(ordered, "place").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("place", "set_key", "name"))).alias("sets"))
    hits = met.join(named, "_id").select("_row", "sets")
    misses = found.where(F.size("numbers") == 0).select("_row", F.array().cast(hits.schema["sets"].dataType).alias("sets"))
    return hits.unionByName(misses).select("_row.*", "sets")


def _every(ordered: DataFrame, step: int, n: int) -> list:
    """The first place of each run of step sets: a row for each pass."""
    if not n:
        return []
    if n <= step:
        return ordered.agg(F.min("place").alias("place")).collect()
    cuts = F.percentile_approx("place", F.array(*[F.lit(i * step / n) for i in range(-(-n // step))]), 100_000)
    return ordered.agg(F.array_distinct(cuts).alias("c")).select(F.explode("c").alias("place")).orderBy("place").collect()


def residual_name(text: Column, sets: Column) -> Column:
    """The text without its collector number, the names and whole keys of its sets, and words of languages and variants, squeezed."""
    quoted = lambda x: F.regexp_replace(x, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    number = ascii_edges(COLLECTOR)
    at, size = F.regexp_instr(text, F.lit(number)), F.length(F.regexp_extract(text, number, 1))
    rest = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + size, F.length(text)))).otherwise(text)
    rest = F.aggregate(sets, rest, lambda t, s: F.regexp_replace(F.regexp_replace(t, F.concat(F.lit("(?i)"), quoted(s["name"])), F.lit(" ")), F.concat(F.lit("(?i)" + EDGE), quoted(s["set_key"]), F.lit(EDGE)), F.lit(" ")))
    rest = F.regexp_replace(F.regexp_replace(rest, ascii_edges(LANGUAGE_WORDS), " "), LANGUAGE_SIGNS, " ")
    variants = "|".join(p for p, _ in VARIANT_TOKENS if "edition" not in p)
    return F.trim(F.regexp_replace(F.regexp_replace(rest, ascii_edges(rf"(?i)\b({variants})\b"), " "), r"\s+", " "))
