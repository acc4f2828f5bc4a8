"""Chat formatting: roles recovered from raw transcripts by a hidden Markov model, then rendered canonically.

A transcript is a sequence of lines. The hidden state of a line is its speaker
(system, user or assistant) and whether it begins a turn or goes on with one.
Observations are speaker markers at the line's start and line features (a
question, a closing mark, an empty line, length). Viterbi finds the most likely
sequence of states; lines from one beginning to the next are a turn.

Scale: a conversation may hold a third of all lines, so Viterbi isn't run over a
whole conversation in one task. Lines are cut into chunks of turns' places; each
chunk gives its max-plus transfer matrix (six by six numbers), the matrices are
combined level by level, the best states at the chunks' ends are handed down
again, and each chunk is decoded between its given ends. The result is the exact
Viterbi path of the whole conversation.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import checkpoint, for_workers

ROLES = ("system", "user", "assistant")
#: State 2 * role begins a turn of it, state 2 * role + 1 goes on with it.
#: The last state stands before the first line and is never entered.
STATES = 2 * len(ROLES) + 1
BEFORE = STATES - 1
#: Places (such as turns of the source) in a chunk, and chunks in a chunk of the next level.
CHUNK = 256
FAN = 64
#: Places beyond this, either way, count as this.
MOST_PLACE = 1 << 61

#: Markers that exports put before a turn, by role: fixed values.
MARKERS = {
    "system": ["system", "sys", "system prompt", "instruction", "instructions"],
    "user": ["user", "human", "customer", "client", "you", "q", "question", "prompter"],
    "assistant": ["assistant", "ai", "bot", "chatbot", "agent", "gpt", "model", "a", "answer", "response"],
}
_ROLE_OF = {m: ROLES.index(role) for role, ms in MARKERS.items() for m in ms}
_NAMES = "|".join(sorted(map(re.escape, _ROLE_OF), key=len, reverse=True))
#: "User: ", "[assistant] ", "### Human:", "**Bot**:", "<|system|>".
MARKER = re.compile(rf"^\s{{0,8}}(?:#{{1,4}}\s{{0,2}}|\*\*|<\|(?:im_start\|>)?|\[|<)?\s?(?P<name>{_NAMES})(?:\s?(?:\*\*\s?[:>]|\|>|\]\s?:?|>\s?:?|[:>])(?:\*\*)?)[ \t]?", re.I)

#: Log-probabilities of the model: fixed values. Rows: last state, columns: next one.
_BEGIN = np.log(np.array([[0.02, 0.88, 0.10], [0.01, 0.09, 0.90], [0.01, 0.90, 0.09]]))
_GO_ON = np.log(0.7)
_FIRST = np.log(np.array([0.15, 0.8, 0.05]))
_NEVER = -1e6


def transitions() -> np.ndarray:
    """Log-probabilities from each state to each: go on with the turn, or begin one."""
    t = np.full((STATES, STATES), _NEVER)
    for s in range(BEFORE):
        role = s // 2
        t[s, 2 * role + 1] = _GO_ON
        for r in range(len(ROLES)):
            t[s, 2 * r] = np.log(1 - np.exp(_GO_ON)) + _BEGIN[role, r]
    t[BEFORE, 0 : 2 * len(ROLES) : 2] = _FIRST
    return t


TRANSITIONS = transitions()
#: How much likelier each feature is for (system, user, assistant): log factors.
_QUESTION = np.log([0.5, 2.0, 0.6])
_SHORT = np.log([0.8, 1.3, 0.9])
_LONG = np.log([0.9, 0.8, 1.3])
_YOU_ARE = np.log([8.0, 0.6, 0.6])
_GREETING = np.log([0.5, 1.5, 1.2])


def emission(line: str) -> np.ndarray:
    """Log-likelihoods of a line in each state, up to a constant."""
    out = np.zeros(STATES)
    found = MARKER.match(line)
    body = line[found.end() :] if found else line
    factors = np.zeros(len(ROLES))
    if body.rstrip().endswith("?"):
        factors += _QUESTION
    if body.strip():
        factors += _SHORT if len(body) < 80 else _LONG if len(body) > 400 else 0.0
    low = body[:40].lower().lstrip()
    if low.startswith(("you are ", "act as ", "your task")):
        factors += _YOU_ARE
    if low.startswith(("hi", "hello", "please", "can you", "how ", "what ", "why ")):
        factors += _GREETING
    begin, go_on = out[0:BEFORE:2], out[1:BEFORE:2]
    begin += factors
    go_on += factors
    if found:
        # a marker begins a turn of its role; otherwise it is text that looks like one
        mark = np.full(len(ROLES), np.log(0.004))
        mark[_ROLE_OF[found["name"].lower()]] = np.log(0.99)
        begin += mark
        go_on += np.log(0.001)
    else:
        # turns mostly begin with a marker, where a transcript has them
        begin += np.log(0.03)
        go_on += np.log(0.999)
        if not line.strip():
            begin += np.log(0.05)
    return out


# --- max-plus algebra ---------------------------------------------------------------------------------------


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product: the best score from a's states through b's."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def step(e: np.ndarray) -> np.ndarray:
    return TRANSITIONS + e[None, :]


def through(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """The best states after each matrix, given the state before the first and after the last."""
    scores, score = [], np.full(STATES, -np.inf)
    score[first] = 0.0
    for m in matrices:
        scores.append(score)
        score = (score[:, None] + m).max(axis=0)
    states = [last]
    for m, s in zip(matrices[::-1], scores[::-1], strict=True):
        states.append(int(np.argmax(s + m[:, states[-1]])))
    return states[::-1][1:]


def best_last(matrix: np.ndarray) -> int:
    """The best last state of a sequence with this transfer matrix."""
    return int(np.argmax(matrix[BEFORE]))


def viterbi(lines: list[str]) -> list[int]:
    """The states of a whole sequence held in memory; the distributed decoding gives the same."""
    steps = [step(emission(x)) for x in lines]
    if not steps:
        return []
    whole = np.full((1, STATES), -np.inf)
    whole[0, BEFORE] = 0.0
    for m in steps:
        whole = multiply(whole, m)
    return through(steps, BEFORE, int(np.argmax(whole[0])))


# --- distributed decoding -----------------------------------------------------------------------------------


def _grouped(batches, keys: int):
    """(key, rows as a table) of each run of equal keys in sorted batches; only one run is held."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_pylist() for k in range(keys)]
        marks = list(zip(*columns, strict=True))
        cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
        for a, b in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield marks[a], table.slice(a, b - a)
        held = table.slice(cuts[-2])
    if held is not None and held.num_rows:
        yield tuple(held.column(k)[0].as_py() for k in range(keys)), held


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by))


def _dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order)


def _batch(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv": pa.string(), "chunk": pa.int64(), "m": pa.list_(pa.float64()), "first": pa.int32(), "last": pa.int32(), "begins": pa.int64(), "role": pa.string(), "text": pa.string(), "n_lines": pa.int64()}
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names.split())
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names.split(), columns, strict=True)], names.split())


def _in_batches(names: str, rows):
    """Rows from an iterator as batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= 2_000:
            yield _batch(names, held)
            held = []
    yield _batch(names, held)


def _matrix(flat: list[float]) -> np.ndarray:
    return np.array(flat).reshape(STATES, STATES)


def _chunk_matrices(batches):
    def rows():
        for (conv, chunk), table in _grouped(batches, 2):
            m = None
            for x in table.column("line").to_pylist():
                s = step(emission(x))
                m = s if m is None else multiply(m, s)
            yield conv, chunk, m.ravel().tolist()

    yield from _in_batches("conv chunk m", rows())


def _products(batches):
    def rows():
        for (conv, up), table in _grouped(batches, 2):
            m = None
            for x in table.column("m").to_pylist():
                m = _matrix(x) if m is None else multiply(m, _matrix(x))
            yield conv, up, m.ravel().tolist()

    yield from _in_batches("conv chunk m", rows())


def _top_ends(batches):
    yield from _in_batches("conv chunk first last", ((conv, chunk, BEFORE, best_last(_matrix(m))) for batch in batches for conv, chunk, m in zip(*(c.to_pylist() for c in batch.columns), strict=True)))


def _hand_down(batches):
    """The ends of each chunk below from the ends of the chunk above."""

    def rows():
        for (conv, _), table in _grouped(batches, 2):
            first = table.column("first")[0].as_py()
            for chunk, last in zip(table.column("chunk").to_pylist(), through([_matrix(x) for x in table.column("m").to_pylist()], first, table.column("last")[0].as_py()), strict=True):
                yield conv, chunk, first, last
                first = last

    yield from _in_batches("conv chunk first last", rows())


def _segments(batches):
    """The stretches of a chunk that belong to one turn: how many turns began in the chunk so far, role, text without its marker, lines."""

    def rows():
        for (conv, chunk), table in _grouped(batches, 2):
            lines = table.column("line").to_pylist()
            states = through([step(emission(x)) for x in lines], table.column("first")[0].as_py(), table.column("last")[0].as_py())
            begins, at = 0, 0
            for i in range(1, len(lines) + 1):
                if i == len(lines) or states[i] % 2 == 0:
                    part, begun = lines[at:i], states[at] % 2 == 0
                    begins += begun
                    found = MARKER.match(part[0]) if begun else None
                    # a marker of another role is text of this turn
                    if found and _ROLE_OF[found["name"].lower()] == states[at] // 2:
                        part = [part[0][found.end() :], *part[1:]]
                    yield conv, chunk, begins, ROLES[states[at] // 2], "\n".join(part), i - at
                    at = i

    yield from _in_batches("conv chunk begins role text n_lines", rows())


def parse_lines(lines: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """conv, turn (from 0), role, text and n_lines of every turn of ``lines`` (conv string, place long, idx int, line string; none null).

    Lines are ordered by place, then idx; lines that tie in both are ordered by
    their text. An empty table gives an empty one.
    """
    # places from 0 on, so that all chunks of a conversation meet in one of a higher level
    place = F.greatest(F.least("place", F.lit(MOST_PLACE)), F.lit(-MOST_PLACE)) + MOST_PLACE
    cut = for_workers(lines).select("conv", _div(place, chunk).alias("chunk"), "place", "idx", "line")
    levels = [checkpoint(_dealt(cut, ["conv", "chunk"], ["place", "idx", "line"]).select("conv", "chunk", "line").mapInArrow(_chunk_matrices, "conv string, chunk long, m array<double>"))]
    while (levels[-1].groupBy("conv").count().agg(F.max("count")).first()[0] or 0) > 1:
        up = levels[-1].select("conv", _div(F.col("chunk"), fan).alias("up"), "chunk", "m")
        levels.append(checkpoint(_dealt(up, ["conv", "up"], ["chunk"]).mapInArrow(_products, "conv string, chunk long, m array<double>")))
    ends = levels[-1].mapInArrow(_top_ends, "conv string, chunk long, first int, last int")
    for level in levels[-2::-1]:
        below = level.select("conv", _div(F.col("chunk"), fan).alias("up"), "chunk", "m").join(ends.withColumnRenamed("chunk", "up"), ["conv", "up"])
        ends = checkpoint(_dealt(below, ["conv", "up"], ["chunk"]).mapInArrow(_hand_down, "conv string, chunk long, first int, last int"))
    known = cut.join(ends, ["conv", "chunk"])
    parts = _dealt(known, ["conv", "chunk"], ["place", "idx", "line"]).select("conv", "chunk", "line", "first", "last")
    parts = checkpoint(parts.mapInArrow(_segments, "conv string, chunk long, begins long, role string, text string, n_lines long"))
    counts = parts.groupBy("conv", "chunk").agg(F.max("begins").alias("_n"))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv", "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = parts.join(starts, ["conv", "chunk"]).withColumn("turn", F.col("_before") + F.col("begins") - 1)
    pieces = F.sort_array(F.collect_list(F.struct("chunk", "text")))
    return numbered.groupBy("conv", "turn").agg(F.min_by("role", "chunk").alias("role"), F.array_join(F.transform(pieces, lambda x: x["text"]), "\n").alias("text"), F.sum("n_lines").alias("n_lines"))


def transcript_lines(transcripts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The lines of raw transcripts, one row a transcript; a null text is one empty line."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    return transcripts.select(_key(id_col), F.posexplode(lines).alias("place", "line")).select("conv", F.col("place").cast("long"), F.lit(0).alias("idx"), "line")


def export_lines(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The lines of the raw transcript that a chat export of a table of turns has: a marker before each turn, then its text. A null role has no marker."""
    marker = F.coalesce(F.concat(F.initcap(F.col(role_col)), F.lit(": ")), F.lit(""))
    lines = F.split(F.concat(marker, F.coalesce(F.col(text_col), F.lit(""))), "\n")
    place = F.coalesce(F.col(turn_col).cast("long"), F.lit(-1)).alias("place")
    return turns.select(_key(id_col), place, F.posexplode(lines).alias("idx", "line"))


def _key(id_col: str):
    """A key that is never null: conversations without an id are one of their own."""
    return F.coalesce(F.concat(F.lit("k"), F.col(id_col).cast("string")), F.lit("n")).alias("conv")


def render(role, text):
    """A turn in canonical form; ``<|`` inside a text is escaped, so the form can be read back exactly."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), escaped, F.lit("<|end|>\n"))


def read_back(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    found = re.findall(r"<\|(\w+)\|>\n(.*?)<\|end\|>\n", rendered, re.S)
    return [(role, re.sub(r"\\(.)", r"\1", text, flags=re.S)) for role, text in found]


def format_chats(lines: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """conv_id (null for rows without one), turn, role, n_lines, text and rendered of every turn of ``lines``."""
    turns = parse_lines(lines, chunk, fan)
    conv = F.when(F.startswith("conv", F.lit("k")), F.expr("substr(conv, 2)"))
    return turns.select(conv.alias("conv_id"), F.col("turn").cast("long"), "role", "n_lines", "text", render(F.col("role"), F.col("text")).alias("rendered"))


#: What the export of a table of turns says, turn by turn: the query's rows wherever every turn has a marker of its
#: role, no text looks like one, and the parse is right.
SQL = r"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, text,
       '<|' || role || '|>' || chr(10) || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' || chr(10) AS rendered
FROM conversations
"""
