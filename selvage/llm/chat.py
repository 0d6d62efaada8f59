"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record is a VARIANT.  The nested field paths it has, out of all paths that
any declared layout names, are hashed; the hash selects the layout's mapping,
which yields canonical turns ``array<struct<role, text>>``.  The template marks
every turn and escapes control strings reversibly, and ``labels`` is a second
string of the same length in which everything outside the loss mask is the
filler U+0000.  Everything is a SQL expression.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
FILLER = "\0"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """``lists``: (array path, role field, text field); else ``fields``: (path, role) in the order of turns."""

    name: str
    lists: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[tuple[str, str], ...] = ()
    order: tuple[str, ...] = ()
    #: Roles have names of their own, see ROLES; elsewhere they stay as they are.
    foreign: bool = False

    def required(self) -> list[str]:
        if self.lists:
            path, role, text = self.lists
            return [f"{path}[0].{role}", f"{path}[0].{text}"]
        return [p for p, _ in self.fields]

    def paths(self) -> list[str]:
        return [*self.required(), *(p for p, _ in self.optional)]

    def fingerprints(self, known: list[str]) -> list[str]:
        extra = [p for p, _ in self.optional]
        return [digest([p for p in known if p in {*self.required(), *some}]) for n in range(len(extra) + 1) for some in combinations(extra, n)]

    def turns(self, record: str) -> Column:
        if self.lists:
            path, role, text = self.lists
            raw = F.expr(f"try_variant_get({record}, '{path}', 'array<struct<{role}:string,{text}:string>>')")
            return F.transform(raw, lambda x: turn(renamed(x[role]) if self.foreign else x[role], x[text]))
        parts = [*self.optional, *self.fields]
        parts.sort(key=lambda x: self.order.index(x[0]) if self.order else 0)
        got = [(F.expr(f"try_variant_get({record}, '{p}', 'string')"), r, (p, r) in self.optional) for p, r in parts]
        made = F.array(*(F.when(v.isNotNull() & (v != ""), turn(F.lit(r), v)) if maybe else turn(F.lit(r), v) for v, r, maybe in got))
        return F.filter(made, lambda x: x.isNotNull())


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def renamed(role: Column) -> Column:
    named = role
    for other, own in ROLES.items():
        named = F.when(role == other, own).otherwise(named)
    return named


ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("messages", lists=("$.messages", "role", "content"), optional=(("$.system", "system"),)),
    Layout("turns", lists=("$.turns", "role", "text"), optional=(("$.system", "system"),)),
    Layout("from_value", lists=("$.conversations", "from", "value"), optional=(("$.system", "system"),), foreign=True),
    Layout("instruction", fields=(("$.instruction", "user"), ("$.output", "assistant")), optional=(("$.input", "user"), ("$.system", "system")),
           order=("$.system", "$.instruction", "$.input", "$.output")),
    Layout("prompt_completion", fields=(("$.prompt", "user"), ("$.completion", "assistant")), optional=(("$.system", "system"),),
           order=("$.system", "$.prompt", "$.completion")),
    Layout("prompt_response", fields=(("$.prompt", "user"), ("$.response", "assistant")), optional=(("$.system", "system"),),
           order=("$.system", "$.prompt", "$.response")),
    Layout("question_answer", fields=(("$.data.question", "user"), ("$.data.answer", "assistant"))),
)
KNOWN = sorted({p for x in LAYOUTS for p in x.paths()})


def digest(paths: list[str]) -> str:
    return hashlib.sha256("|".join(paths).encode()).hexdigest()


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns``; a record that no layout fits has a null layout and null turns.

    Fields that no layout names don't matter.  Nor do fields of other layouts
    beside a list of turns, unless they make a whole record of theirs.  A null record has no paths and so
    no layout.  Missing roles and texts are empty strings.
    """
    def has(path: str) -> Column:
        head, _, field = path.partition("[0].")
        if not field:
            return F.expr(f"try_variant_get({record}, '{path}', 'variant')").isNotNull()
        # a field of a list is there if any element has it
        return F.exists(F.expr(f"try_variant_get({record}, '{head}', 'array<variant>')"), lambda v: F.try_variant_get(v, f"$.{field}", "variant").isNotNull())

    there = F.array_compact(F.array(*(F.when(has(p), p) for p in KNOWN)))

    def whole(x: Layout) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, x.required())), there)) == 0

    # beside a list of turns that is the only whole layout, fields of other layouts aren't hashed
    hashed = there
    for x in LAYOUTS:
        if x.lists:
            alone = reduce(lambda a, b: a & ~b, [whole(x), *(whole(y) for y in LAYOUTS if y is not x)])
            hashed = F.when(alone, F.array_intersect(there, F.array(*map(F.lit, x.paths())))).otherwise(hashed)
    out = records.withColumn("fingerprint", F.sha2(F.array_join(hashed, "|"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for x in LAYOUTS:
        fits = F.col("fingerprint").isin(x.fingerprints(KNOWN))
        if x.lists and x.optional:
            lead = F.expr(f"try_variant_get({record}, '{x.optional[0][0]}', 'string')")
            own = F.concat(F.filter(F.array(F.when(lead != "", turn(F.lit("system"), lead))), lambda t: t.isNotNull()), x.turns(record))
        else:
            own = x.turns(record)
        layout, turns = F.when(fits, x.name).otherwise(layout), F.when(fits, own).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns)


def escape(text: Column) -> Column:
    """No control string and no filler is left in a text: ``<|``, ``<0`` and ``<1`` get a backslash more, U+0000 becomes ``<0``."""
    return F.replace(F.regexp_replace(text, r"<(\\*)([|01])", r"<\\$1$2"), F.lit(FILLER), F.lit("<0"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("<0"), F.lit(FILLER)), r"<\\(\\*)([|01])", r"<$1$2")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<1"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<1"), F.lit("\n")))


def format_turns(rows: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``labels`` for canonical ``turns``; no turns make empty strings, null turns nulls."""
    def head(t: Column) -> Column:
        return F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))

    def text(t: Column) -> Column:
        return F.concat(head(t), escape(t["text"]), F.lit(END))

    def label(t: Column) -> Column:
        body = escape(t["text"])
        own = F.when(t["role"] == "assistant", body).otherwise(F.repeat(F.lit(FILLER), F.char_length(body)))
        return F.concat(F.repeat(F.lit(FILLER), F.char_length(head(t))), own, F.lit(FILLER * len(END)))

    return rows.withColumn("formatted", F.array_join(F.transform("turns", text), "")).withColumn(
        "labels", F.array_join(F.transform("turns", label), ""))


def read_back(formatted: str = "formatted") -> Column:
    """Turns of a formatted string, unescaped."""
    marks = F.split(F.col(formatted), r"<\|im_end\|>\n")
    own = F.slice(marks, 1, F.size(marks) - 1)

    def one(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(
            unescape_role(F.substring(role, len(START) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring(x, F.char_length(role) + 2, F.lit(2**31 - 1))).alias("text"))

    return F.transform(own, one)


def loss_text(labels: str = "labels") -> Column:
    """All text under the loss mask, unescaped span by span."""
    return F.array_join(F.transform(F.regexp_extract_all(labels, F.lit(r"([^\x00]+)"), 1), unescape), "")


def _grouped(rows: DataFrame) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    return rows.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))


def conversation_records(rows: DataFrame) -> DataFrame:
    """``conv_id, record``: rows ``(conv_id, turn, role, text)`` as one record of the ``turns`` layout per conversation.

    Turns are ordered by ``turn``, ties by role and text; repeated rows repeat
    turns; a null text or role is empty; rows without ``conv_id`` make one
    conversation without an id.  One conversation is one record by nature, so it
    has to fit into memory.
    """
    return _grouped(rows).select("conv_id", F.expr("to_variant_object(struct(transform(turns, t -> struct(t.role as role, t.text as text)) as turns))").alias("record"))


def mixed_records(rows: DataFrame) -> DataFrame:
    """As :func:`conversation_records`, in differing layouts by ``conv_id``.

    A question and its answer may be written with prompt and completion, prompt
    and response, instruction and output, or nested; conversations of users,
    assistants and systems alone with the foreign role names; a first turn of
    the system in a field of its own, if it says something; any other
    conversation as messages or turns.
    """
    plain = "transform(turns, t -> struct(t.role as role, t.text as {})) as {}"
    pair = "size(turns) = 2 AND turns[0].role = 'user' AND turns[1].role = 'assistant'"
    known = "forall(turns, t -> t.role IN ('user', 'assistant', 'system'))"
    lead = "size(turns) > 1 AND turns[0].role = 'system' AND turns[0].text <> ''"
    foreign = "transform(turns, t -> struct(CASE t.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE t.role END as `from`, t.text as value)) as conversations"
    rest = "turns[0].text as system, transform(slice(turns, 2, size(turns) - 1), t -> struct(t.role as role, t.text as content)) as messages"
    cases = [
        (f"k = 0 AND {pair}", "turns[0].text as prompt, turns[1].text as completion"), (f"k = 1 AND {pair}", "turns[0].text as prompt, turns[1].text as response, k as id"),
        (f"k = 2 AND {pair}", "turns[0].text as instruction, '' as input, turns[1].text as output"), (f"k = 3 AND {pair}", "struct(turns[0].text as question, turns[1].text as answer) as data"),
        (f"k < 4 AND {lead}", rest), (f"k = 4 AND {known}", foreign), ("k < 6", plain.format("content", "messages"))]
    chosen = " ".join(f"WHEN {c} THEN to_variant_object(struct({x}))" for c, x in cases)
    record = f"CASE {chosen} ELSE to_variant_object(struct({plain.format('text', 'turns')})) END"
    return _grouped(rows).withColumn("k", F.expr("pmod(coalesce(conv_id, 0), 8)")).select("conv_id", F.expr(record).alias("record"))
