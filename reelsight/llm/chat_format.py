"""Chat formatting by schema fingerprint, in DataFrame functions only.

Prompt, instruction and message layouts are declared as mappings from field
paths to canonical turns.  The nested field paths that a record (or a table's
schema) has are hashed; the hash selects the mapping.  Canonical turns are then
rendered by a template that marks each turn and escapes control strings inside
texts reversibly, with the code-point spans of what is learned (the loss mask).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from reelsight.llm.common import blank

# ------------------------------------------------------------------ layouts

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and how they become turns.

    ``items``: path of a list whose ``role`` and ``text`` fields are turns; or
    ``fields``: (role, path, required) of single texts, in order of turns.
    """
    name: str
    items: str | None = None
    role: str = ""
    text: str = ""
    turn: str | None = None
    fields: tuple[tuple[str, str, bool], ...] = ()

    def path_sets(self) -> list[tuple[str, ...]]:
        if self.items:
            need = [f"{self.items}[].{x}" for x in (self.role, self.text)]
            extra = [f"{self.items}[].{self.turn}"] if self.turn else []
        else:
            need = [p for _, p, required in self.fields if required]
            extra = [p for _, p, required in self.fields if not required]
        return [tuple(sorted(need + list(some))) for r in range(len(extra) + 1) for some in combinations(extra, r)]


#: Field names of common public layouts.
LAYOUTS = (
    Layout("messages", items="messages", role="role", text="content"),
    Layout("sharegpt", items="conversations", role="from", text="value"),
    Layout("turns", items="turns", role="role", text="text", turn="turn"),
    Layout("instruction", fields=(("system", "system", False), ("user", "instruction", True),
                                  ("user", "input", False), ("assistant", "output", True))),
    Layout("prompt_response", fields=(("system", "system", False), ("user", "prompt", True),
                                      ("assistant", "response", True))),
    Layout("prompt_completion", fields=(("system", "system", False), ("user", "prompt", True),
                                        ("assistant", "completion", True))),
    Layout("question_answer", fields=(("system", "system", False), ("user", "question", True),
                                      ("assistant", "answer", True))),
)
ROLE_ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN_PATHS = tuple(sorted({p for layout in LAYOUTS for s in layout.path_sets() for p in s}))


def fingerprint(paths) -> str:
    """Hash of the known field paths among ``paths``; other fields don't change it."""
    return hashlib.md5("\n".join(sorted(set(paths) & set(KNOWN_PATHS))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(s): layout for layout in LAYOUTS for s in layout.path_sets()}


def schema_paths(kind: DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type; lists add ``[]``."""
    if isinstance(kind, StructType):
        dot = f"{at}." if at else ""
        return [p for f in kind.fields for p in schema_paths(f.dataType, dot + f.name)]
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at]


def _known_role(role: Column) -> Column:
    lowered = F.lower(blank(role))
    out = blank(role)
    for alias, name in ROLE_ALIASES.items():
        out = F.when(lowered == alias, F.lit(name)).otherwise(out)
    return out


def _item_turns(layout: Layout, items: Column, paths) -> Column:
    numbered = layout.turn and f"{layout.items}[].{layout.turn}" in paths
    turns = F.transform(items, lambda x, i: F.struct(
        (x[layout.turn].cast("long") if numbered else i.cast("long")).alias("turn"),
        _known_role(x[layout.role].cast("string")).alias("role"), blank(x[layout.text].cast("string")).alias("text")))
    return F.sort_array(turns) if numbered else turns


def _field_turns(layout: Layout, get) -> Column:
    """Single fields in order; optional fields that are null or absent make no turn, and
    texts of one role that follow one another are one turn, joined by a blank line."""
    merged: list[tuple[str, list[Column]]] = []
    for role, path, required in layout.fields:
        text = get(path)
        if text is None:
            continue
        text = blank(text.cast("string")) if required else text.cast("string")
        if merged and merged[-1][0] == role:
            merged[-1][1].append(text)
        else:
            merged.append((role, [text]))
    turns = [F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"),
                      F.when(F.coalesce(*texts).isNotNull(), F.concat_ws("\n\n", *texts)).alias("text"))
             for i, (role, texts) in enumerate(merged)]
    return F.filter(F.array(*turns), lambda t: t["text"].isNotNull())


def canonical_turns(records: DataFrame, out: str = "canonical") -> DataFrame:
    """Add canonical turns to typed records: the schema's fingerprint selects the mapping.

    The columns ``layout`` and ``out`` (array of turn, role, text) replace ones
    of that name.  Raises ``ValueError`` for a schema of no known layout.
    """
    paths = schema_paths(records.schema)
    layout = BY_FINGERPRINT.get(fingerprint(paths))
    if layout is None:
        raise ValueError(f"no layout has the field paths {sorted(set(paths) & set(KNOWN_PATHS))}")
    if layout.items:
        turns = _item_turns(layout, F.col(layout.items), paths)
    else:
        turns = _field_turns(layout, lambda p: F.col(p) if p in paths else None)
    return records.withColumns({"layout": F.lit(layout.name), out: F.coalesce(turns, F.array().cast(TURNS))})


def canonical_turns_json(records: DataFrame, json_col: str, out: str = "canonical") -> DataFrame:
    """The same for JSON records, each with its own layout.

    A record's fingerprint hashes the known paths that hold a value in it.  A
    record of no known layout, null or broken JSON included, stays with layout
    null and no turns.
    """
    text = F.col(json_col)

    def at(path: str) -> str:
        return "$." + path.replace("[]", "[*]")

    present = F.concat_ws("\n", *[F.when(F.get_json_object(text, at(p)).isNotNull(), F.lit(p)) for p in KNOWN_PATHS])
    mark = F.md5(present.cast("binary"))
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for layout in LAYOUTS:
        own = mark.isin([fp for fp, x in BY_FINGERPRINT.items() if x is layout])
        if layout.items:
            fields = [layout.role, layout.text] + ([layout.turn] if layout.turn else [])
            shape = "struct<`%s`: array<struct<%s>>>" % (layout.items, ", ".join(
                f"`{x}`: {'bigint' if x == layout.turn else 'string'}" for x in fields))
            items = F.from_json(text, shape)[layout.items]
            paths = [f"{layout.items}[].{layout.turn}"]
            made = _item_turns(layout, items, paths if layout.turn else [])
        else:
            made = _field_turns(layout, lambda p: F.get_json_object(text, at(p)))
        name, turns = F.when(own, F.lit(layout.name)).otherwise(name), F.when(own, made).otherwise(turns)
    return records.withColumns({"layout": name, out: F.coalesce(turns, F.array().cast(TURNS))})


# ------------------------------------------------------------------ template

START, STOP = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "␛"
_HIDDEN, _SELF, _LINE = ESCAPE + "1", ESCAPE + "0", ESCAPE + "2"


def _quote(text: str) -> str:
    return "".join("\\" + c if c in "|[]<>()/.*+?" else c for c in text)


_INSIDE = "|".join(f"(?<={_quote(c[0])})(?={_quote(c[1:])})" for c in CONTROL)


def escape(text: Column) -> Column:
    """Break every control string after its first character; ``unescape`` undoes it."""
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(_SELF)), _INSIDE, _HIDDEN)


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_HIDDEN), F.lit("")), F.lit(_SELF), F.lit(ESCAPE))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(_LINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(_LINE), F.lit("\n")))


def render(records: DataFrame, turns: str = "canonical", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and its loss mask ``loss_runs``.

    Each turn is START role LF text STOP.  The mask is run-length coded over the
    code points of ``formatted``: (length, loss) for the head, the text and the
    stop of each turn; only texts of ``loss_roles`` are learned.
    """
    parts = F.transform(F.col(turns), lambda t: F.struct(
        F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"),
        t["role"].isin(*loss_roles).alias("loss")))
    run = lambda n, loss: F.struct(n.cast("long").alias("length"), loss.alias("loss"))
    return records.withColumn("__parts", parts).withColumns({
        "formatted": F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(STOP))), ""),
        "loss_runs": F.flatten(F.transform("__parts", lambda p: F.array(
            run(F.char_length(p["head"]), F.lit(False)), run(F.char_length(p["body"]), p["loss"]),
            run(F.lit(len(STOP)), F.lit(False)))))}).drop("__parts")


def read_turns(formatted: Column, loss_runs: Column) -> Column:
    """Array of (role, text, learned) read back from a formatted record; learned is the
    text under the mask, null where the mask has none."""
    pieces = F.split(formatted, _quote(STOP))
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p, i: F.struct(
        unescape_role(F.substr(F.substring_index(p, "\n", 1), F.lit(len(START) + 1))).alias("role"),
        unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        F.when(F.get(loss_runs, i * 3 + 1)["loss"], unescape(F.substr(
            p, F.get(loss_runs, i * 3)["length"].cast("int") + 1, F.get(loss_runs, i * 3 + 1)["length"].cast("int"))))
        .alias("learned")))


def group_turn_rows(rows: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) to one record per conversation with a list ``turns``.

    Rows are ordered by turn, ties by role and text, a null turn first; repeated
    rows are turns each.  Rows without an id are one conversation without an id.
    """
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        F.col("turn").cast("long").alias("turn"), blank(F.col("role").cast("string")).alias("role"),
        blank(F.col("text").cast("string")).alias("text")))).alias("turns"))


def format_digest(conversations: DataFrame) -> DataFrame:
    """Format all conversations and describe each as read back from the output.

    Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.  Null texts and roles are empty; other columns are ignored.
    """
    out = render(canonical_turns(group_turn_rows(conversations)).select("conv_id", "canonical")).select(
        "conv_id", "formatted", "loss_runs")
    # What follows reads the output alone.
    read = out.select("conv_id", F.char_length("formatted").cast("long").alias("formatted_chars"),
                      read_turns(F.col("formatted"), F.col("loss_runs")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("turns", lambda t: blank(t["learned"])), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text) plus conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                "role", "text").unionAll(probe)
