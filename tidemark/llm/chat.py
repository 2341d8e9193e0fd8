"""Chat formatting with DataFrame functions only: records of several layouts become canonical turns, then one text.

A record is a variant (parsed JSON or a nested struct). Its fingerprint is a hash of those nested field paths, out of
the ones that some layout knows, that the record has. The fingerprint selects a declarative mapping to canonical turns
(role, text). Fields that no layout knows don't matter. The loss mask of a formatted text is a list of spans: where the
texts of its assistant turns stand in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read

TURN, END = "<|turn|>", "<|end|>\n"
#: In this order when escaping, in the reverse when reading back. Without "<" and "[" no control string is left in a text.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "&#10;")]
LOSS_ROLE = "assistant"
#: A column that is there only while layouts are selected.
PRINT = "__fingerprint_of_record"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """list_at: the array of messages with its role and text fields; or else fields: (path, role) in order of the turns."""

    name: str
    list_at: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> list[str]:
        if self.list_at:
            at, role, text = self.list_at
            return [f"{at}[].{role}", f"{at}[].{text}"]
        return [p for p, _ in self.fields]

    def fingerprints(self) -> list[frozenset[str]]:
        """With each choice of the optional fields."""
        must = set(self.paths()) - set(self.optional)
        return [frozenset(must | set(more)) for more in chain.from_iterable(combinations(self.optional, n) for n in range(len(self.optional) + 1))]


LAYOUTS = [
    Layout("messages", list_at=("messages", "role", "content")),
    Layout("from_value", list_at=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt_response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Layout("prompt_completion", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input")),
]


def fingerprint_of(paths: frozenset[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def has(record: Column, path: str) -> Column:
    """Whether a variant has a field, of whatever type; of an array, whether each item has it as a field of its own (an empty array has all)."""
    at, _, item = path.partition("[].")
    if not item:
        return F.try_variant_get(record, f"$.{at}", "variant").isNotNull()
    items = F.try_variant_get(record, f"$.{at}", "array<variant>")
    return F.coalesce(F.forall(items, lambda m: F.try_variant_get(m, f"$.{item}", "variant").isNotNull()), F.lit(False))


def fingerprint(record: Column, layouts: list[Layout]) -> Column:
    known = sorted({p for x in layouts for p in x.paths()})
    present = F.filter(F.array(*[F.when(has(record, p), F.lit(p)) for p in known]), lambda x: x.isNotNull())
    return F.xxhash64(F.array_join(present, "\n"))


def turns_of(record: Column, layout: Layout) -> Column:
    def role(x: Column) -> Column:
        for old, new in layout.roles.items():
            x = F.when(x == old, F.lit(new)).otherwise(x)
        return F.coalesce(x, F.lit(""))

    if layout.list_at:
        at, by, text = layout.list_at
        items = F.try_variant_get(record, f"$.{at}", f"array<struct<`{by}`: string, `{text}`: string>>")
        return F.transform(items, lambda m: F.struct(role(m[by]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    parts = [(F.try_variant_get(record, f"$.{p}", "string"), p in layout.optional, r) for p, r in layout.fields]
    made = [F.when(x.isNotNull() if may_lack else F.lit(True), F.struct(F.lit(r).alias("role"), F.coalesce(x, F.lit("")).alias("text"))) for x, may_lack, r in parts]
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def canonical(records: DataFrame, layouts: list[Layout] | None = None) -> DataFrame:
    """records, of which `record` is a variant, with layout (null: none fits) and turns (role, text; null: none fits); other columns stay as they are.

    A list of messages fits a layout only if each of its items has the layout's fields as its own.
    """
    layouts = layouts or LAYOUTS
    found = records.withColumn(PRINT, fingerprint(F.col("record"), layouts))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        own = F.lit(False)
        for p in x.fingerprints():
            own = own | (F.col(PRINT) == fingerprint_of(p))
        layout, turns = F.when(own, F.lit(x.name)).otherwise(layout), F.when(own, turns_of(F.col("record"), x)).otherwise(turns)
    return found.withColumns({"layout": layout, "turns": turns}).drop(PRINT)


def escape(x: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    for old, new in escapes:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def unescape(x: Column, escapes: list[tuple[str, str]] = ESCAPES) -> Column:
    for old, new in reversed(escapes):
        x = F.replace(x, F.lit(new), F.lit(old))
    return x


def marked(t: Column) -> Column:
    """A turn as it stands in the formatted text."""
    return F.concat(F.lit(TURN), escape(t["role"], ROLE_ESCAPES), F.lit("\n"), escape(t["text"]), F.lit(END))


def loss_spans(turns: Column) -> Column:
    """(start, length), in code points of the formatted text, of the text alone of each assistant turn."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, length: int>>").alias("spans"))

    def add(a: Column, t: Column) -> Column:
        n, whole = F.length(escape(t["text"])), F.length(marked(t))
        span = F.struct((a["at"] + whole - n - len(END)).alias("start"), n.alias("length"))
        spans = F.when(t["role"] == LOSS_ROLE, F.concat(a["spans"], F.array(span))).otherwise(a["spans"])
        return F.struct((a["at"] + whole).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda a: a["spans"])


def under_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, read from the formatted text."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


def joined(items: Column) -> Column:
    return F.array_join(items, "")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    raw = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)

    def of(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - 1 - len(END))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(raw, of)


def format_chat(records: DataFrame, layouts: list[Layout] | None = None) -> DataFrame:
    """records with layout, turns, formatted and loss_spans (array of start, length: the loss mask on formatted).

    record: a variant column. A record that no layout fits, and a null one, keeps its row with null in the new columns.
    Null roles and texts count as empty. A conversation without turns gives an empty text. Columns of these names in the
    input are replaced; all others stay. Rows that repeat stay; no rows give no rows. Texts are whole, of any length.
    Nothing is shuffled.
    """
    found = canonical(records, layouts)
    return found.withColumns({"formatted": joined(F.transform("turns", marked)), "loss_spans": loss_spans(F.col("turns"))})


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, record: the rows by turn, of columns conv_id, turn, role, text, as records of the messages layout.

    Turns stand in order of turn (null first), then role, then text. Null conv_id is a conversation of its own.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("found"))
    messages = F.transform("found", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def digest(x: Column) -> Column:
    return F.sha2(F.encode(x, "UTF-8"), 256)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    odd = F.to_variant_object(F.struct(F.lit(own).alias("prompt"), F.lit(own).alias("response"))).alias("record")
    rows = conversations_of(read(spark, sf_dir, "conversations"))
    out = format_chat(rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), odd)))
    turns = read_back(F.col("formatted"))
    loss = joined(under_loss(F.col("formatted"), F.col("loss_spans")))
    return out.withColumns({"back": turns, "loss": loss}).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        digest(joined(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        digest(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
    + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;')) + 17 AS n FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
