"""Chat formatting by schema fingerprints: DataFrame functions only.

Records come as JSON in many layouts. The hash of a record's nested field paths selects one of the
declared mappings, which turns the record into canonical turns; the turns are then rendered with a
template whose control strings can't occur in any text, and read back from what was rendered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Every control string starts with one of these characters; & comes first as it starts their stand-ins.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
_TURNS = "array<struct<role:string,text:string>>"
#: Entries of an array that are gone through as one.
CHUNK = 256


@dataclass(frozen=True)
class Layout:
    """How records with the field paths of one of the examples become turns.

    Either messages names an array with a role and a text field, or parts gives (role, path) pairs in
    order, of which absent and empty ones are left out. roles renames the layout's own role names."""

    name: str
    examples: tuple[str, ...]
    messages: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


LAYOUTS = (
    Layout("messages", ('{"messages":[{"role":"a","content":"b"}]}', '{"messages":[]}'), "messages", "role", "content"),
    Layout("shared", ('{"conversations":[{"from":"a","value":"b"}]}', '{"conversations":[]}'), "conversations", "from", "value", roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt", ('{"prompt":"a","response":"b"}', '{"prompt":"a","response":"b","system":"c"}'), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ('{"prompt":"a","completion":"b"}',), parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ('{"instruction":"a","output":"b"}', '{"instruction":"a","input":"c","output":"b"}', '{"instruction":"a","input":"c","output":"b","system":"d"}'), parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def field_paths(record: Column) -> Column:
    """A variant's nested field paths, in order of name, whatever the types of its scalars."""
    return F.regexp_replace(F.schema_of_variant(record), r"(?<=[:<] ?)(?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|DATE|TIMESTAMP|TIMESTAMP_NTZ|VOID|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "_")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _prints(spark: SparkSession, layouts: tuple[Layout, ...]) -> dict[str, list[int]]:
    """Fingerprints of the layouts' examples: as many rows as there are examples."""
    examples = [(x.name, e) for x in layouts for e in x.examples]
    marks = spark.range(1).select(*[fingerprint(F.parse_json(F.lit(e))).alias(f"p{i}") for i, (_, e) in enumerate(examples)]).first()
    out: dict[str, list[int]] = {}
    for (name, _), mark in zip(examples, marks, strict=True):
        out.setdefault(name, []).append(mark)
    return out


def _turns(record: Column, layout: Layout) -> Column:
    if layout.messages:
        raw = F.try_variant_get(record, f"$.{layout.messages}", "array<variant>")
        turn = lambda m: F.struct(F.coalesce(F.try_variant_get(m, f"$.{layout.role}", "string"), F.lit("")).alias("role"), F.coalesce(F.try_variant_get(m, f"$.{layout.text}", "string"), F.lit("")).alias("text"))
        turns = F.transform(raw, turn)
        if layout.roles:
            names = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair])
            turns = F.transform(turns, lambda t: F.struct(F.coalesce(names[t.role], t.role).alias("role"), t.text.alias("text")))
        return turns
    parts = [F.struct(F.lit(role).alias("role"), F.try_variant_get(record, f"$.{path}", "string").alias("text")) for role, path in layout.parts]
    return F.filter(F.array(*parts), lambda t: F.coalesce(t.text, F.lit("")) != "")


def canonical_turns(records: DataFrame, column: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout (the name of the mapping selected) and turns (role and text, in order).

    column holds one JSON record per row. Defined cases: a record that is null, no JSON, or of an unknown
    fingerprint has layout null and turns null; null roles and texts are empty strings; other columns stay, but
    for any called layout or turns, which give way."""
    prints = _prints(records.sparkSession, layouts)
    record = F.try_parse_json(column)
    mark = fingerprint(record)
    name = turns = None
    for layout in layouts:
        hit = mark.isin(prints[layout.name])
        name = F.when(hit, layout.name) if name is None else name.when(hit, layout.name)
        own = _turns(record, layout)
        turns = F.when(hit, own) if turns is None else turns.when(hit, own)
    return records.withColumns({"layout": name, "turns": turns.cast(_TURNS)})


def escape(text: Column) -> Column:
    for plain, stand_in in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(stand_in))
    return text


def unescape(text: Column) -> Column:
    for plain, stand_in in reversed(ESCAPES):
        text = F.replace(text, F.lit(stand_in), F.lit(plain))
    return text


def _header(role: Column) -> Column:
    return F.concat(F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body's lambdas look at it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chunks(items: Column) -> Column:
    """An array as an array of arrays of CHUNK entries, the last of what is left."""
    return _let(items, lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(1), F.size(a), F.lit(CHUNK)), lambda i: F.slice(a, i, CHUNK))).otherwise(F.slice(F.array(a), 1, 0)))


def _running(start: Column, sizes: Column) -> Column:
    """Where each of sizes begins, the first at start; quadratic in an array's length."""
    none = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("begins"))
    return F.aggregate(sizes, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins")), lambda acc: acc["begins"])


def begins(sizes: Column) -> Column:
    """Where each of an array of sizes begins if they stand one after the other: CHUNK entries at a time, then chunk by chunk."""
    zero = F.lit(0).cast("bigint")
    total = lambda chunk: F.aggregate(chunk, zero, lambda x, n: x + n)
    return _let(_chunks(sizes), lambda chunks: F.flatten(F.zip_with(chunks, _running(zero, F.transform(chunks, total)), lambda chunk, at: _running(at, chunk))))


def render(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """turns with formatted (one string) and loss_spans: start (0-based) and length, in code points, of each learnt text.

    Columns of these names give way. A conversation is one string, and so one task's work, up to Spark's 2 GB a value;
    its time grows with its turns, but for a square of a CHUNK-th of them."""
    parts = F.transform("turns", lambda t: F.struct(_header(t.role).alias("head"), escape(t.text).alias("body"), (t.role == learn).alias("learnt")))
    made_parts = "_".join(["parts", *turns.columns])  # no column's name
    made = turns.withColumn(made_parts, parts)
    formatted = F.array_join(F.transform(made_parts, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    size = F.transform(made_parts, lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("bigint"))
    span = lambda p, at: F.struct((at + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("bigint").alias("length"), p["learnt"].alias("learnt"))
    learnt = F.filter(F.zip_with(made_parts, begins(size), span), lambda s: s["learnt"])
    return made.withColumns({"formatted": formatted, "loss_spans": F.transform(learnt, lambda s: F.struct(s["start"], s["length"]))}).drop(made_parts)


def read_back(rendered: DataFrame) -> DataFrame:
    """rendered with read_turns, parsed from formatted alone, and loss_text: what loss_spans covers in it, unescaped."""

    def turn(part: Column) -> Column:
        role = F.substring_index(part, "\n", 1)
        body = F.substring(part, F.length(role) + 2, F.length(part) - F.length(role) - 1 - len(END))
        return F.struct(unescape(F.replace(role, F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    def learnt(spans: Column) -> Column:
        # a chunk's stretch of the string is cut out first, as finding a place in a string means counting from its front
        first, last = F.element_at(spans, 1)["start"], F.element_at(spans, -1)
        stretch = F.substring(F.col("formatted"), (first + 1).cast("int"), (last["start"] + last["length"] - first).cast("int"))
        return _let(stretch, lambda text: F.array_join(F.transform(spans, lambda s: unescape(F.substring(text, (s["start"] - first + 1).cast("int"), s["length"].cast("int")))), ""))

    parts = F.split("formatted", r"<\|turn\|>")
    loss_text = F.array_join(F.transform(_chunks(F.col("loss_spans")), learnt), "")
    return rendered.withColumns({"read_turns": F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn), "loss_text": loss_text})


def _conversations(rows: DataFrame) -> DataFrame:
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    return grouped.select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages"))


def conversation_records(rows: DataFrame) -> DataFrame:
    """One JSON record of the messages layout per conversation, from rows of one turn each.

    Turns are in order of turn, then role and text where turns tie; null roles and texts are empty."""
    return _conversations(rows).select("conv_id", F.to_json(F.struct("messages")).alias("record"))


def varied_records(rows: DataFrame) -> DataFrame:
    """Like conversation_records, in several of the LAYOUTS by conv_id, as a corpus of many origins has them.

    A conversation takes another layout only if that one can tell all of it: prompt and response of one user's and
    one assistant's text that aren't empty, shared of roles that aren't that layout's own names."""
    names = {"user": "human", "assistant": "gpt"}
    renamed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    shared = F.transform("messages", lambda m: F.struct(F.coalesce(renamed[m["role"]], m["role"]).alias("from"), m["content"].alias("value")))
    is_pair = (F.size("messages") == 2) & F.forall("messages", lambda m: m["content"] != "")
    said = lambda i: F.get("messages", F.lit(i))
    is_pair &= (said(0)["role"] == "user") & (said(1)["role"] == "assistant")
    is_plain = F.forall("messages", lambda m: ~m["role"].isin(*names.values()))
    draw = F.pmod(F.xxhash64("conv_id"), F.lit(3))
    pair = F.to_json(F.struct(said(0)["content"].alias("prompt"), said(1)["content"].alias("response")))
    record = F.when((draw == 0) & is_pair, pair).when((draw < 2) & is_plain, F.to_json(F.struct(shared.alias("conversations")))).otherwise(F.to_json(F.struct("messages")))
    return _conversations(rows).select("conv_id", record.alias("record"))


def format_chats(records: DataFrame, column: str = "record") -> DataFrame:
    """records in any known layout with layout, turns, formatted, loss_spans, read_turns and loss_text.

    Records of no known layout are kept with nulls, to be set aside by the caller."""
    return read_back(render(canonical_turns(records, column)))
