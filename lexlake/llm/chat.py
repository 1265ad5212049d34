"""Chat formatting: layouts are recognised by the hash of their field paths, with built-in functions only.

Records of any layout come as VARIANT values. The nested field paths of a record, without the scalar types, are hashed;
the hash selects a declarative mapping that turns the record into canonical turns (role, text). A record whose hash no mapping
declares keeps its fingerprint, has layout null and no turns, so that it can be counted and set aside.

The template encloses each turn in markers by role. Control strings inside texts are escaped reversibly: every backslash is
doubled, and a single backslash goes in behind the first character of each control string, so that none is left whole.
Under the loss mask lies each assistant text; the mask has one entry a turn (turn_chars, skip, loss_chars), lengths
in code points of the escaped text, so that formatted text is cut turn by turn without searching from its start.

Defined results: a null text or role is empty; turns are ordered by turn, then role, then text, nulls first; repeated rows are
turns of their own; a conversation is one value of the result, so its turns meet in one task by contract, and a very long text is escaped
and formatted within its row; an empty table gives an empty result; other columns are kept, but for those with the name of a result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TURNS = "array<struct<role string, text string>>"
#: Markers around the text of a turn, by role. Any other role: [ROLE]role[TEXT]text[/ROLE].
MARKERS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
_CONTROL = r"(<)(/?s>|</?SYS>>)|(\[)(/?INST\]|/?ROLE\]|TEXT\])"
_TURN = r"(?s)(?:<<SYS>>|\[INST\]|<s>|\[ROLE\]).*?(?:<</SYS>>|\[/INST\]|</s>|\[/ROLE\])"


@dataclass(frozen=True)
class Layout:
    """paths: fields that a record must have; optional: fields that it may have besides.

    messages: (array, role field, text field) for records that list their turns, with other names of roles in aliases;
    fields: (role, field, ...) for records with a field for each turn, several fields joined by a blank line.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    messages: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, ...], ...] = ()

    def signatures(self) -> list[str]:
        options = chain.from_iterable(combinations(self.optional, k) for k in range(len(self.optional) + 1))
        return [signature([*self.paths, *more]) for more in options]


LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), ("id", "source"), messages=("messages", "role", "content")),
    Layout("turns", ("turns[].role", "turns[].text", "turns[].turn"), ("id",), messages=("turns", "role", "text")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("id", "source"), messages=("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"), ("input", "system", "id"), fields=(("system", "system"), ("user", "instruction", "input"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "response"), ("system", "id"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("prompt", "completion"), ("id",), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("question", "answer"), ("context", "id"), fields=(("user", "context", "question"), ("assistant", "answer"))),
)
ROLE_ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def signature(paths: list[str]) -> str:
    """Field paths as one string, fields in order: {a, b[].c} is OBJECT<a, b: ARRAY<OBJECT<c>>>."""

    def write(below: list[list[str]]) -> str:
        names = sorted({p[0] for p in below})
        parts = []
        for name in names:
            inner = write([p[1:] for p in below if p[0] == name and len(p) > 1]) if any(p[0] == name and len(p) > 1 for p in below) else ""
            inner = f"ARRAY<{inner}>" if inner and name.endswith("[]") else inner
            parts.append(name.removesuffix("[]") + (f": {inner}" if inner else ""))
        return f"OBJECT<{', '.join(parts)}>"

    return write([p.split(".") for p in paths])


#: Names of scalar types in a variant's schema; ARRAY, OBJECT and VARIANT (values of several kinds) are none.
_SCALARS = "VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL|STRING|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|UUID"


def fingerprint(record: Column) -> Column:
    """Hash of a record's nested field paths; scalar types (and nulls) don't count, but arrays and fields of mixed kinds do."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), rf": (?:{_SCALARS})(?:\([0-9,]*\))?(?=[,>])", ""))


def _turns(layout: Layout, record: Column) -> Column:
    if layout.messages:
        array, role, text = layout.messages
        said = F.variant_get(record, f"$.{array}", f"array<struct<`{role}` string, `{text}` string>>")
        alias = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_ALIASES.items() for x in pair]), r), r)
        return F.transform(said, lambda m: F.struct(alias(F.coalesce(m[role], F.lit(""))).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    made = []
    for role, *names in layout.fields:
        values = [F.variant_get(record, f"$.{n}", "string") for n in names]
        some = F.lit(False)
        for v in values:
            some = some | v.isNotNull()
        must = any(n in layout.paths for n in names)
        turn = F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *values).alias("text"))
        made.append(turn if must else F.when(some, turn))
    return F.filter(F.array(*made), lambda t: t.isNotNull())


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with fingerprint, layout (null: no mapping) and turns, in place of columns of these names; the record column must be called otherwise."""
    hashed = records.withColumn("fingerprint", fingerprint(F.col(record)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for known in reversed(layouts):
        hit = F.col("fingerprint").isin([F.xxhash64(F.lit(s)) for s in known.signatures()])
        layout = F.when(hit, known.name).otherwise(layout)
        turns = F.when(hit, _turns(known, F.col(record)).cast(TURNS)).otherwise(turns)
    return hashed.withColumn("layout", layout).withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _piece(turn: Column) -> Column:
    """text of one formatted turn and its entry of the loss mask."""
    opening, closing, inside = F.concat(F.lit(OTHER[0]), escape(turn["role"]), F.lit(OTHER[1])), F.lit(OTHER[2]), escape(turn["text"])
    for role, (a, b) in MARKERS.items():
        opening, closing = F.when(turn["role"] == role, F.lit(a)).otherwise(opening), F.when(turn["role"] == role, F.lit(b)).otherwise(closing)
    return F.struct(opening.alias("opening"), inside.alias("inside"), closing.alias("closing"), (turn["role"] == "assistant").alias("loss"))


def format_turns(chats: DataFrame, turns: str = "turns") -> DataFrame:
    """chats with formatted and loss_mask (in place of columns of these names) instead of their turns."""
    held = common.free_name(chats, "_pieces")
    pieces = chats.withColumn(held, F.transform(turns, _piece)).drop(turns)
    entry = lambda p: F.struct(
        (F.length(p["opening"]) + F.length(p["inside"]) + F.length(p["closing"])).cast("long").alias("turn_chars"),
        F.length(p["opening"]).cast("long").alias("skip"), F.when(p["loss"], F.length(p["inside"])).otherwise(0).cast("long").alias("loss_chars"),
    )
    text = F.array_join(F.transform(held, lambda p: F.concat(p["opening"], p["inside"], p["closing"])), "")
    return pieces.withColumn("formatted", text).withColumn("loss_mask", F.transform(held, entry)).drop(held)


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns and loss_text (all text under the mask, unescaped), parsed from formatted and loss_mask, in place of columns of these names."""
    held = common.free_name(formatted, "_parts")
    parts = formatted.withColumn(held, F.regexp_extract_all("formatted", F.lit(_TURN), F.lit(0)))

    def turn(p: Column) -> Column:
        role, text = F.regexp_extract(p, r"(?s)^\[ROLE\](.*?)\[TEXT\]", 1), F.regexp_extract(p, r"(?s)^\[ROLE\].*?\[TEXT\](.*)\[/ROLE\]$", 1)
        for name, (a, b) in MARKERS.items():
            hit = p.startswith(a)
            role, text = F.when(hit, F.lit(name)).otherwise(role), F.when(hit, F.substring(p, F.lit(len(a) + 1), F.length(p) - len(a) - len(b))).otherwise(text)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    masked = F.zip_with(held, "loss_mask", lambda p, m: unescape(F.substring(p, (m["skip"] + 1).cast("int"), m["loss_chars"].cast("int"))))
    return parts.withColumn("turns", F.transform(held, turn)).withColumn("loss_text", F.array_join(masked, "")).drop(held)


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id and a record of layout `turns` for each conversation of a table (conv_id, turn, role, text)."""
    said = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))
    return grouped.select("conv_id", F.to_variant_object(F.struct("turns")).alias("record"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.to_variant_object(F.struct(tricky.alias("prompt"), tricky.alias("response"))).alias("record"))
    records = conversation_records(common.read(spark, sf_dir, "conversations")).union(own)
    done = read_back(format_turns(canonical_turns(records).drop("record")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op1_chat_format": op1_chat_format}
SQL = {
    "op1_chat_format": r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, turn IS NULL AS no_turn, role IS NULL AS no_role, text IS NULL AS no_text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', false, false, false
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', false, false, false),
escaped AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY no_turn DESC, turn, no_role DESC, role, no_text DESC, text) AS n,
    regexp_replace(replace(text, '\', '\\'), '(<)(/?s>|</?SYS>>)|(\[)(/?INST\]|/?ROLE\]|TEXT\])', '\1\3\\\2\4', 'g') AS inside,
    regexp_replace(replace(role, '\', '\\'), '(<)(/?s>|</?SYS>>)|(\[)(/?INST\]|/?ROLE\]|TEXT\])', '\1\3\\\2\4', 'g') AS other
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(inside) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(other) END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
}
