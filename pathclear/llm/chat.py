"""Chat formatting from heterogeneous layouts, with DataFrame functions only.

The nested field paths of a table's schema are hashed; the hash selects a declarative mapping that turns
its rows into canonical turns (conv_id, turn, role, text). Rows of JSON text are told apart one by one in
the same way. Turns are written with control strings around them; a control string inside a text is
escaped reversibly, so the formatted text can be read back to the same turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
#: Speaker names of common layouts and the roles they stand for; other names stay as they are.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(kind: T.DataType, path: str = "") -> list[str]:
    """Paths of all leaves; an array adds []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, path + "[]")
    return [path]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """``turns``: (role, path) of the parts of one row in order; or ``listed``: array, role and text fields;
    or ``flat``: one turn a row (turn, role, text)."""

    turns: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None
    flat: tuple[str, str, str] | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        if self.listed:
            return (f"{self.listed[0]}[].{self.listed[1]}", f"{self.listed[0]}[].{self.listed[2]}")
        return self.flat or tuple(p for _, p in self.turns)


LAYOUTS = tuple(
    Layout(**x) for x in (
        {"flat": ("turn", "role", "text")},
        {"listed": ("messages", "role", "content")},
        {"listed": ("conversations", "from", "value")},
        {"turns": (("user", "prompt"), ("assistant", "response"))},
        {"turns": (("user", "prompt"), ("assistant", "completion"))},
        {"turns": (("system", "system"), ("user", "prompt"), ("assistant", "response"))},
        {"turns": (("user", "instruction"), ("assistant", "output"))},
        {"turns": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
        {"turns": (("system", "system_prompt"), ("user", "question"), ("assistant", "response"))},
        {"turns": (("user", "question"), ("assistant", "answer"))},
    )
)
#: Mapping of every known fingerprint.
MAPPINGS = {fingerprint(x.paths): x for x in LAYOUTS}


def layout_of(schema: T.StructType) -> Layout:
    """The mapping with most fields whose fingerprint is that of the schema's fields it names."""
    have = set(field_paths(schema))
    fits = [x for key, x in MAPPINGS.items() if fingerprint(have & set(x.paths)) == key]
    if not fits:
        raise ValueError(f"no mapping for the fields {sorted(have)}")
    return max(fits, key=lambda x: len(x.paths))


def _role(name: Column, field: str) -> Column:
    """Speaker names are translated where the layout calls them otherwise than roles."""
    if field == "role":
        return F.coalesce(name, F.lit(""))
    known = F.create_map(*[F.lit(v) for pair in ROLES.items() for v in pair])
    return F.coalesce(F.try_element_at(known, F.lower(name)), name, F.lit(""))


def _turn_array(layout: Layout, field) -> Column:
    """Array of (role, text) of one row; ``field`` gives the column of a path."""
    if layout.listed:
        _, role, text = layout.listed
        return F.transform(field(layout.listed[0]), lambda m: F.struct(
            _role(m[role], role).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    parts = [F.when(field(path).isNotNull(), F.struct(F.lit(role).alias("role"), field(path).alias("text")))
             for role, path in layout.turns]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def canonical_turns(rows: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """``conv_id, turn long, role, text`` of every turn, for any known layout of ``rows``.

    Null roles and texts are empty; in layouts with one field for each part, null parts are no turns, and
    null or empty lists give none. Columns that the layout does not name are not read.
    """
    layout = layout_of(rows.schema)
    if layout.flat:
        turn, role, text = layout.flat
        return rows.select(
            F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
            _role(F.col(role), role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = _turn_array(layout, F.col)
    return rows.select(F.col(conv_id).alias("conv_id"), F.posexplode(turns).alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def canonical_turns_of_json(rows: DataFrame, json: str, conv_id: str = "conv_id") -> DataFrame:
    """The same for one JSON object a row, each with a layout of its own.

    Objects that fit no mapping, and text that is no object, give no turns; :func:`unmapped` lists them.
    """
    seen = rows.select(F.col(conv_id).alias("conv_id"), F.try_parse_json(json).alias("v"))
    cases = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in sorted((x for x in LAYOUTS if not x.flat), key=lambda x: len(x.paths)):
        if layout.listed:
            array, role, text = layout.listed
            kind = f"array<struct<`{role}`:string,`{text}`:string>>"
            turns = _turn_array(layout, lambda p, k=kind: F.try_variant_get("v", f"$.{p}", k))
        else:
            turns = _turn_array(layout, lambda p: F.try_variant_get("v", f"$.{p}", "string"))
        cases = F.when(_json_key(layout) == F.lit(fingerprint(layout.paths)), turns).otherwise(cases)
    return seen.select("conv_id", F.posexplode(cases).alias("turn", "m")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def _json_key(layout: Layout) -> Column:
    """Fingerprint of the layout's paths that an object has (a list's by its first item)."""
    def there(path: str) -> Column:
        return F.when(F.try_variant_get("v", "$." + path.replace("[]", "[0]"), "string").isNotNull(), F.lit(path))

    paths = F.array(*[there(p) for p in sorted(layout.paths)])
    return F.substring(F.sha2(F.array_join(paths, "\n"), 256), 1, 16)


def unmapped(rows: DataFrame, json: str) -> DataFrame:
    """Rows whose JSON fits no mapping."""
    v = rows.withColumn("v", F.try_parse_json(json))
    fits = F.lit(False)
    for layout in LAYOUTS:
        if not layout.flat:
            fits = fits | (_json_key(layout) == F.lit(fingerprint(layout.paths)))
    return v.filter(F.col("v").isNull() | ~fits).drop("v")


def escaped(text: Column) -> Column:
    """One more backslash between < and | (and any backslashes there), so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def format_chats(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss`` of every conversation.

    Turns stand in the order of turn, role and text (nulls first), so ties and repeated rows have a fixed
    place. ``loss`` lists what is trained on, the texts of ``trained`` turns: the turn's number in
    ``formatted``, the first code point in that turn and their number. Roles are percent-encoded where they
    hold anything but letters, digits and ``.-*_``. Rows without a conv_id are conversations of their own.
    Null roles and texts are empty; an empty table gives an empty table.
    """
    own = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    rows = turns.select(
        "conv_id", own.alias("own"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.groupBy("conv_id", "own").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    body = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("text"),
        (t["role"] == F.lit(trained)).alias("trained")))
    return gathered.withColumn("parts", body).select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "").alias("formatted"),
        F.filter(
            F.transform("parts", lambda p, i: F.struct(
                i.alias("turn"), F.length(p["head"]).alias("start"),
                F.when(p["trained"], F.length(p["text"])).alias("length"))),
            lambda s: s["length"].isNotNull()).alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) of a formatted text."""
    cut = F.split(formatted, r"<\|im_end\|>\n")
    return F.transform(F.slice(cut, 1, F.size(cut) - 1), lambda s: F.struct(
        F.url_decode(F.substring_index(s.substr(F.lit(len(START) + 1), F.length(s)), "\n", 1)).alias("role"),
        unescaped(s.substr(F.instr(s, "\n") + 1, F.length(s))).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    cut = F.split(formatted, r"<\|im_end\|>\n")
    return F.array_join(F.transform(loss, lambda s: unescaped(
        F.element_at(cut, s["turn"] + 1).substr(s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from the output of :func:`format_chats`."""
    back = chats.select(
        "conv_id", read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss")).alias("trained"), F.length("formatted").alias("n"))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.col("n").cast("long").alias("formatted_chars"),
    )


#: The same figures in SQL.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), sized AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) AS n FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + length(role) + 24) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
