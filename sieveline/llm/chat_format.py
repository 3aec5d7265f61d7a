"""Chat records of any known layout to canonical turns, and turns to text with a loss mask.

A record's fingerprint is the set of hashes of its nested field paths (from the schema of its variant
value). A declarative mapping says where turns, roles and texts stand, and applies to every record that
has all paths of the mapping's example, whatever other fields it has; of several that with most paths.
Message contents may be texts or lists of parts. Turns are then written with marks. Control strings
inside texts and roles are broken up by a backslash, and backslashes doubled, so the text between marks
can be read back exactly. Everything is DataFrame expressions.

Rows of turns become records whose texts are numbers of a list beside the record, whatever their length, so what is parsed
and fingerprinted is small: one way for all sizes.

Cases: null texts and roles count as empty; turns are sorted by number, role and text, nulls first;
a record that is no JSON, too long for Spark's parser (a string of 20,000,000 characters, a value of 128 MiB) or of an
unknown layout has no turns, ``layout`` is null, ``unknown`` holds the record and ``reason`` says which; a null record has
none of these; an empty list of messages gives no turns; repeated rows of a conversation are turns of their own; an
empty table gives an empty result; other columns are not looked at. A conversation is one row, however long: its texts
must fit in one (2 GB), its turns be fewer than about two million.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
BEGIN, FINISH = "<|im_start|>", "<|im_end|>\n"
#: Before these positions a backslash goes: a backslash, or the second part of a control string.
BREAK = r"(?=\\)|(?<=<)(?=\|)|(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])|(?<=<<)(?=/?SYS>>)"
#: What the text of a schema consists of: names, and the beginnings and ends of what nests.
_TOKEN = r"(`(?:[^`]|``)+`: |[^<>,: `]+: |OBJECT<|ARRAY<VOID>|ARRAY<|>)"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns.

    example: a record with the fields that it must have. Either ``list_at`` names an array of objects
    with fields ``role`` and ``text``, or ``fixed`` lists (role, paths) in order: a turn's text joins
    those paths that aren't empty by a blank line; a turn none of whose paths is there is left out.
    """

    name: str
    example: str
    list_at: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()

    def turns(self, value: Column, texts: Column | None = None) -> Column:
        """texts: a list that the record's texts are numbers of, from 0."""
        if not self.list_at:
            if not self.fixed:
                return F.array().cast(TURNS)
            return F.array_compact(F.array(*(self._fixed(value, texts, *f) for f in self.fixed)))
        found = F.try_variant_get(value, self.list_at, f"array<struct<`{self.role}`:string,`{self.text}`:variant>>")

        def turn(t: Column) -> Column:
            role = F.coalesce(t[self.role], F.lit(""))
            renamed = role
            for old, new in self.roles.items():
                renamed = F.when(role == old, new).otherwise(renamed)
            return F.struct(renamed.alias("role"), given_text(t[self.text], texts).alias("text"))

        return F.transform(found, turn)

    @staticmethod
    def _fixed(value: Column, given: Column | None, role: str, paths: tuple[str, ...]) -> Column:
        there = F.array_compact(F.array(*(F.try_variant_get(value, p, "variant") for p in paths)))
        texts = F.filter(F.transform(there, lambda c: given_text(c, given)), lambda t: t != "")
        return F.when(F.size(there) > 0, F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n\n").alias("text")))


def content_text(content: Column) -> Column:
    """A text as it is; of a list of parts their texts, parts of another kind as JSON; null as empty."""
    parts = F.try_variant_get(content, "$", "array<variant>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.try_variant_get(p, "$", "string"), F.lit(""))), "")
    return F.coalesce(F.when(F.startswith(F.schema_of_variant(content), F.lit("ARRAY<")), joined), F.try_variant_get(content, "$", "string"), F.lit(""))


def given_text(content: Column, texts: Column | None = None) -> Column:
    """``content_text``, or the one of ``texts`` whose number it is."""
    text = content_text(content)
    return text if texts is None else F.coalesce(F.get(texts, text.try_cast("int")), F.lit(""))


def _pair(name: str, first: str, second: str, *before: tuple[str, str]) -> Layout:
    example = "{" + ",".join(f'"{x}":""' for x in (*(b for _, b in before), first, second)) + "}"
    return Layout(name, example, fixed=(*((r, (f"$.{x}",)) for r, x in before), ("user", (f"$.{first}",)), ("assistant", (f"$.{second}",))))


#: Layouts in common use.
LAYOUTS = (
    Layout("messages", '{"messages":[{"role":"","content":""}]}', "$.messages", "role", "content"),
    Layout("no_messages", '{"messages":[]}'),
    Layout("shared", '{"conversations":[{"from":"","value":""}]}', "$.conversations", "from", "value", {"human": "user", "gpt": "assistant"}),
    Layout("conversations", '{"conversations":[{"role":"","content":""}]}', "$.conversations", "role", "content"),
    Layout("no_conversations", '{"conversations":[]}'),
    _pair("prompt", "prompt", "completion"),
    _pair("response", "prompt", "response"),
    _pair("system_prompt", "prompt", "response", ("system", "system")),
    _pair("question", "question", "answer"),
    Layout("instruction", '{"instruction":"","output":""}', fixed=(("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("instruction_response", '{"instruction":"","response":""}', fixed=(("system", ("$.system",)), ("user", ("$.instruction", "$.input")), ("assistant", ("$.response",)))),
)


def field_paths(schema: Column) -> Column:
    """The nested field paths of a schema's text, "[]" for elements: one walk over its tokens with a stack of open containers."""
    top = lambda s: F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(""))
    to = lambda at, stack, paths: F.struct(at.alias("at"), stack.alias("open"), paths.alias("paths"))

    def step(s: Column, token: Column) -> Column:
        named = F.concat(top(s), F.lit("."), F.substring(token, F.lit(1), F.length(token) - 2))
        element = F.concat(s["at"], F.lit("[]"))
        return (
            F.when(token == ">", to(s["at"], F.slice(s["open"], 1, F.size(s["open"]) - 1), s["paths"]))
            .when(token == "OBJECT<", to(s["at"], F.concat(s["open"], F.array(s["at"])), s["paths"]))
            .when(token == "ARRAY<", to(element, F.concat(s["open"], F.array(element)), s["paths"]))
            .when(token == "ARRAY<VOID>", to(s["at"], s["open"], F.concat(s["paths"], F.array(F.concat(element, F.lit(" none"))))))
            .otherwise(to(named, s["open"], F.concat(s["paths"], F.array(named))))
        )

    none = F.array().cast("array<string>")
    return F.aggregate(F.regexp_extract_all(schema, F.lit(_TOKEN), F.lit(1)), to(F.lit(""), none, none), step)["paths"]


def fingerprint(value: Column) -> Column:
    """Hashes of the nested field paths of a variant value."""
    return F.array_distinct(F.transform(field_paths(F.schema_of_variant(value)), lambda p: F.xxhash64(p)))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, BREAK, r"\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _known(spark, layouts: tuple[Layout, ...]) -> list[tuple[Layout, list[int]]]:
    """Layouts with the fingerprints of their examples, those with most paths first."""
    rows = spark.range(1).select(*(fingerprint(F.parse_json(F.lit(x.example))).alias(f"l{i}") for i, x in enumerate(layouts))).first()
    return sorted(zip(layouts, map(list, rows), strict=True), key=lambda x: -len(x[1]))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, texts: str | None = None) -> DataFrame:
    """``records`` with columns layout, turns, unknown (a record that has no turns for want of a layout) and reason in place of ``record``.

    texts: a column of lists of texts; the texts of a record are then numbers of its list.
    """
    # Columns of their own: what several mappings use is computed once a row.
    marked = records.withColumn("__value", F.try_parse_json(record))
    marked = marked.withColumn("__mark", fingerprint(F.col("__value")))
    name: Column = F.lit(None).cast("string")
    turns: Column = F.lit(None).cast(TURNS)
    given = F.col(texts) if texts else None
    for one, paths in reversed(_known(records.sparkSession, layouts)):
        is_it = F.size(F.array_except(F.array(*map(F.lit, paths)), F.col("__mark"))) == 0
        name = F.when(is_it, one.name).otherwise(name)
        turns = F.when(F.col("__layout") == one.name, one.turns(F.col("__value"), given).cast(TURNS)).otherwise(turns)
    marked = marked.withColumn("__layout", name)
    missing = F.col("__layout").isNull() & F.col(record).isNotNull()
    reason = F.when(missing, F.when(F.col("__value").isNull(), F.lit("no JSON, or too long to parse")).otherwise(F.lit("unknown layout")))
    rest = (F.col(f"`{c}`") for c in records.columns if c not in (record, texts, "layout", "turns", "unknown", "reason"))
    return marked.select(*rest, F.col("__layout").alias("layout"), turns.alias("turns"), F.when(missing, F.col(record)).alias("unknown"), reason.alias("reason"))


def format_turns(turned: DataFrame, turns: str = "turns", learn: str = "assistant") -> DataFrame:
    """Adds formatted (text) and loss_spans (start and end in code points of each text to learn)."""
    head = lambda t: F.concat(F.lit(BEGIN), F.regexp_replace(escaped(t["role"]), "(?=\n)", r"\\"), F.lit("\n"))
    pieces = F.transform(turns, lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == learn).alias("learn")))
    with_pieces = turned.withColumn("__pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        a = acc["at"] + F.length(p["head"])
        b = a + F.length(p["body"])
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct((b + len(FINISH)).alias("at"), F.when(p["learn"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    text = F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(FINISH))), "")
    spans = F.aggregate("__pieces", start, step)["spans"]
    return with_pieces.withColumn("formatted", F.coalesce(text, F.lit(""))).withColumn("loss_spans", spans).drop("__pieces")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    shape = r"(?s)\A<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)\z"
    return F.transform(parts, lambda p: F.struct(unescaped(F.regexp_extract(p, shape, 1)).alias("role"), unescaped(F.regexp_extract(p, shape, 2)).alias("text")))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def records_of_rows(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, record, texts: rows of turns as JSON records in the layout that suits their roles; a record's texts are numbers of ``texts``."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    grouped = rows.groupBy(F.col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(one), _by_turn).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    number = lambda i: i.cast("string")
    messages = F.to_json(F.struct(F.transform("t", lambda t, i: F.struct(t["role"].alias("role"), number(i).alias("content"))).alias("messages")))
    old = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    shared = F.to_json(F.struct(F.transform("t", lambda t, i: F.struct(old(t["role"]).alias("from"), number(i).alias("value"))).alias("conversations")))
    first, second, third = (F.lit(str(i)) for i in range(3))
    prompt = F.to_json(F.struct(first.alias("prompt"), second.alias("completion"), F.col("conv_id").alias("id")))
    instruction = F.to_json(F.struct(first.alias("instruction"), second.alias("output")))
    system = F.to_json(F.struct(first.alias("system"), second.alias("prompt"), third.alias("response")))
    is_roles = lambda *names: roles == F.array(*map(F.lit, names))
    plain = F.forall(roles, lambda r: r.isin("system", "user", "assistant"))
    even = F.pmod("conv_id", F.lit(2)) == 0
    record = F.when(is_roles("user", "assistant") & even, instruction).when(is_roles("user", "assistant"), prompt).when(is_roles("system", "user", "assistant"), system)
    record = record.when(plain & (F.pmod("conv_id", F.lit(2)) == 1), shared).otherwise(messages)
    return grouped.select("conv_id", record.alias("record"), F.transform("t", lambda t: t["text"]).alias("texts"))


def _by_turn(a: Column, b: Column) -> Column:
    def compare(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x.eqNullSafe(y), rest).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    return compare(a["turn"], b["turn"], compare(a["role"], b["role"], compare(a["text"], b["text"], F.lit(0))))


def format_conversations(records: DataFrame) -> DataFrame:
    """conv_id, layout, unknown, reason, formatted, loss_spans for records (conv_id, record, and texts if the records hold numbers of them)."""
    return format_turns(canonical_turns(records, texts="texts" if "texts" in records.columns else None)).drop("turns")
