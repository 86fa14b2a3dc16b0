"""Roles of transcripts by a hidden Markov model.

A transcript is lines without roles: (conv_id, place, line). The hidden state of a line is its
role and whether it begins a turn; what is seen of it are its speaker marker, its length, its
end and its start. Start, transition and emission counts come from lines whose roles are known,
summed over all of them, and are smoothed by SMOOTHING. Viterbi then gives the most likely states, and
every run of lines from a beginning on is rendered as one canonical turn.

A transcript may be any part of all lines, so Viterbi runs in pieces. A piece of PIECE lines is a
matrix: the best score from every state before it to every state at its end. Matrices multiply in
max-plus, so pieces of pieces are matrices too, level by level, until one is left; then the way back
down fixes the states between pieces, and inside each piece. Pieces are all alike in size, whatever
the transcript, and the result is exactly that of one pass.

Cases: null and empty lines are lines without marker; equal places are ordered by their text, equal
lines twice are two lines; a null conv_id is a transcript; a role never seen in training is never
recovered; without training lines every line is a user's; an empty table gives an empty result;
columns of other names are not carried.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from touchline.llm.common import stored, unit_interval

ROLES = ("system", "user", "assistant")
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
PIECE = 256
# Added to every count.
SMOOTHING = 0.05
# Places that are numbered together.
RUN = 64
# Names that introduce a speaker, by role.
SPEAKERS = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "question", "q", "you", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent", "gpt"),
}
NAMES = "|".join(sorted({name for names in SPEAKERS.values() for name in names}, key=lambda name: (-len(name), name)))
# A name as "Name:", "Name>", "[Name]", "<|name|>", "**Name:**", "### Name" at the start of a line.
SPEAKER_PATTERN = rf"^\s*(?:(?:[*#>]{{1,4}}\s*)?(?i:{NAMES})\s*[:>]\**|\[(?i:{NAMES})\]:?|<\|?(?i:{NAMES})\|?>|#{{1,4}}\s*(?i:{NAMES})\s*$)\s*"
MARKER = re.compile(SPEAKER_PATTERN)
LETTERS = re.compile("[A-Za-z]+")
ENDS = ("", "?", ".", "!", ":", "other")
STARTS = ("", "upper", "lower", "digit", "other")
# Kinds of each feature; one symbol is one value of all four.
KINDS = (len(ROLES) + 1, 6, len(ENDS), len(STARTS))


def marker_of(line: str) -> tuple[int, int]:
    """Which role the line's marker names (0: none) and where the words after it begin."""
    match = MARKER.match(line)
    if match is None:
        return 0, 0
    name = LETTERS.search(match[0])[0].lower()
    return next(at for at, role in enumerate(ROLES) if name in SPEAKERS[role]) + 1, match.end()


def features(line: str | None) -> tuple[int, int, int, int]:
    line = line or ""
    marker, at = marker_of(line)
    rest = line[at:].strip()
    length = min(int(np.log2(len(rest) + 1) / 2), KINDS[1] - 1)
    end = 0 if not rest else ENDS.index(rest[-1]) if rest[-1] in "?.!:" else len(ENDS) - 1
    first = rest[:1]
    start = 0 if not first else 1 if first.isupper() else 2 if first.islower() else 3 if first.isdigit() else 4
    return marker, length, end, start


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: list[np.ndarray]  # for each feature, states x kinds

    def costs(self, lines: list[str | None]) -> np.ndarray:
        """Log probability of every line in every state."""
        seen = np.array([features(line) for line in lines], dtype=np.int64).reshape(-1, len(KINDS))
        return sum(table[:, seen[:, at]].T for at, table in enumerate(self.emit))


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` (conv_id, place, part, line) with their running ``number`` from 0 in each transcript.

    Lines are counted by (transcript, run of RUN places); runs are numbered over their counts, lines
    inside their run, so no window holds more than a run or one row per run.
    """
    run = F.floor(F.col("place") / RUN)
    dealt = lines.withColumn("run", run)
    sizes = dealt.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("n"))
    above = stored(sizes, "hmm-runs").withColumn("block", F.floor(F.col("run") / RUN))
    totals = stored(above.groupBy("conv_id", "block").agg(F.sum("n").alias("n")), "hmm-blocks")
    before = lambda part, order: F.coalesce(F.sum("n").over(Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = stored(totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), before(["conv_id"], "block").alias("block_before")), "hmm-before")
    runs = above.withColumn("run_before", before(["conv_id", "block"], "run")).join(
        blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))
    )
    runs = stored(runs.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), (F.col("block_before") + F.col("run_before")).alias("run_start")), "hmm-starts")
    inside = F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("place", "part", "line")) - 1
    return (
        dealt.withColumn("inside", inside)
        .join(runs, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("run").eqNullSafe(F.col("r")))
        .withColumn("number", (F.col("run_start") + F.col("inside")).cast("long"))
        .drop("run", "inside", "c", "r", "run_start")
    )


def state_counts(lines: DataFrame) -> DataFrame:
    """Counts of starts, moves between states of neighbouring lines, and feature values by state.

    ``lines`` has conv_id, number, line, role and begins. A neighbour is met by its number, in
    pieces of PIECE lines with one more line from the piece before.
    """
    state = F.lit(None).cast("int")
    for at, (role, begins) in enumerate(STATES):
        state = F.when((F.col("role") == role) & (F.col("begins") == begins), F.lit(at)).otherwise(state)
    known = lines.select("conv_id", "number", "line", state.alias("state")).where("state is not null")
    piece = F.floor(F.col("number") / PIECE)
    led = known.select(
        "conv_id", "number", "state",
        F.explode(F.array_distinct(F.array(piece, F.floor((F.col("number") + 1) / PIECE)))).alias("piece"),
    )
    own = Window.partitionBy("conv_id", "piece").orderBy("number")
    moved = (
        led.withColumn("before", F.lag("state").over(own))
        .where((F.col("number") == 0) | F.col("before").isNotNull())
        .where(F.col("piece") == piece)
    )
    moves = moved.groupBy(
        F.when(F.col("number") == 0, F.lit("start")).otherwise(F.lit("move")).alias("kind"),
        F.when(F.col("number") == 0, F.lit(0)).otherwise(F.col("before")).alias("a"), F.col("state").alias("b"),
    ).agg(F.count(F.lit(1)).alias("n"))

    def counted(batches):
        for batch in batches:
            found: Counter[tuple[str, int, int]] = Counter()
            for state, line in zip(batch.column("state").to_pylist(), batch.column("line").to_pylist()):
                found.update((f"feature {at}", state, value) for at, value in enumerate(features(line)))
            kinds, a, b = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(found.values(), pa.int64())],
                names=["kind", "a", "b", "n"],
            )

    seen = known.select("state", "line").mapInArrow(counted, "kind string, a int, b int, n long")
    return moves.unionByName(seen).groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def fitted(counts: DataFrame) -> Model:
    """A few hundred counts, whatever the corpus, make the model."""
    sizes = {"start": (1, len(STATES)), "move": (len(STATES), len(STATES))} | {f"feature {at}": (len(STATES), kinds) for at, kinds in enumerate(KINDS)}
    tables = {kind: np.full(size, SMOOTHING) for kind, size in sizes.items()}
    for row in counts.collect():
        tables[row["kind"]][row["a"], row["b"]] += row["n"]
    # A line that begins no turn goes on with the role before it, and no transcript begins with one.
    for b, (following, begins) in enumerate(STATES):
        if not begins:
            tables["start"][0, b] = 1e-12
            for a, (role, _) in enumerate(STATES):
                if role != following:
                    tables["move"][a, b] = 1e-12
    logs = {kind: np.log(table / table.sum(axis=1, keepdims=True)) for kind, table in tables.items()}
    return Model(logs["start"][0], logs["move"], [logs[f"feature {at}"] for at in range(len(KINDS))])


def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (left[:, :, None] + right[None, :, :]).max(axis=1)


def best_between(steps: list[np.ndarray], before: int, end: int) -> list[int]:
    """States after each step on the best way from ``before`` to ``end``; ties go to the first state."""
    scores, back = steps[0][before], []
    for step in steps[1:]:
        ways = scores[:, None] + step
        back.append(ways.argmax(axis=0))
        scores = ways.max(axis=0)
    states = [end]
    for pointers in reversed(back):
        states.append(int(pointers[states[-1]]))
    return states[::-1]


def line_steps(model: Model, numbers: list[int], lines: list[str | None]) -> list[np.ndarray]:
    """A matrix per line: from the state before to its own; line 0 has the start's scores from every state."""
    costs = model.costs(lines)
    return [(model.move if number else model.start[None, :].repeat(len(STATES), 0)) + cost[None, :] for number, cost in zip(numbers, costs)]


def unpacked(values: bytes) -> np.ndarray:
    return np.frombuffer(values).reshape(len(STATES), len(STATES))


def by_group(df: DataFrame, keys: tuple[str, ...], order: str, fn, result: StructType) -> DataFrame:
    """Rows that ``fn(key, rows)`` gives for each group; a group's rows are tuples of keys, order and
    the other columns, in order. Groups must be bounded: they are met in sorted partitions, one at a time."""
    names = [*keys, order, *[c for c in df.columns if c not in (*keys, order)]]
    arrow = to_arrow_schema(result)

    def batch_of(rows):
        columns = list(zip(*rows)) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(columns, arrow)], names=arrow.names)

    def run(batches):
        key, held, found = None, [], []
        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if row[: len(keys)] != key:
                    if held:
                        found += fn(key, held)
                    key, held = row[: len(keys)], []
                held.append(row)
            yield batch_of(found)
            found = []
        yield batch_of(fn(key, held) if held else [])

    dealt = df.select(*names).repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInArrow(run, result)


def decode(lines: DataFrame, model: Model) -> DataFrame:
    """``lines`` (conv_id, number, line and more) with the ``state`` that Viterbi gives each."""
    held = lines.sparkSession.sparkContext.broadcast(model)
    pieces = stored(lines.withColumn("piece", F.floor(F.col("number") / PIECE).cast("long")), "hmm-lines")
    numbers = lambda names, kind: [StructField(name, kind) for name in names]
    form = StructType([*numbers(("conv_id", "piece"), LongType()), StructField("matrix", BinaryType())])
    bounds = StructType([*numbers(("conv_id", "piece"), LongType()), *numbers(("before", "end"), IntegerType())])

    def matrices(key, rows):
        whole = reduce(product, line_steps(held.value, [row[2] for row in rows], [row[3] for row in rows]))
        return [(*key, whole.tobytes())]

    def merged(key, rows):
        return [(*key, reduce(product, (unpacked(row[3]) for row in rows)).tobytes())]

    def within(key, rows):
        _, _, _, _, before, end = rows[0]
        states = best_between([unpacked(row[3]) for row in rows], before, end)
        return [(key[0], row[2], start, state) for row, start, state in zip(rows, [before, *states], states)]

    def roots(batches):
        for batch in batches:
            ends = [int(unpacked(values)[0].argmax()) for values in batch.column("matrix").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("piece"), pa.array([0] * len(ends), pa.int32()), pa.array(ends, pa.int32())],
                names=["conv_id", "piece", "before", "end"],
            )

    levels = [stored(by_group(pieces.select("conv_id", "piece", "number", "line"), ("conv_id", "piece"), "number", matrices, form), "hmm-level")]
    up = F.floor(F.col("piece") / PIECE).cast("long")
    while (levels[-1].agg(F.max("piece")).first()[0] or 0) > 0:
        above = levels[-1].select("conv_id", up.alias("above"), "piece", "matrix")
        levels.append(stored(by_group(above, ("conv_id", "above"), "piece", merged, form), "hmm-level"))
    fixed = stored(levels[-1].mapInArrow(roots, bounds), "hmm-fixed")
    for level in reversed(levels[:-1]):
        below = level.select("conv_id", up.alias("above"), "piece", "matrix")
        met = below.join(_renamed(fixed), F.col("conv_id").eqNullSafe(F.col("fixed_conv")) & (F.col("above") == F.col("fixed_piece")))
        fixed = stored(by_group(met.select("conv_id", "above", "piece", "matrix", "before", "end"), ("conv_id", "above"), "piece", within, bounds), "hmm-fixed")

    others = [c for c in pieces.columns if c not in ("conv_id", "piece", "number", "line")]

    def settled(key, rows):
        steps = line_steps(held.value, [row[2] for row in rows], [row[3] for row in rows])
        states = best_between(steps, rows[0][-2], rows[0][-1])
        return [(*row[:-2], state) for row, state in zip(rows, states)]

    met = pieces.join(_renamed(fixed), F.col("conv_id").eqNullSafe(F.col("fixed_conv")) & (F.col("piece") == F.col("fixed_piece")))
    named = met.select("conv_id", "piece", "number", "line", *others, "before", "end")
    result = StructType([*named.schema.fields[:-2], StructField("state", IntegerType())])
    return by_group(named, ("conv_id", "piece"), "number", settled, result).drop("piece")


def _renamed(fixed: DataFrame) -> DataFrame:
    return fixed.select(F.col("conv_id").alias("fixed_conv"), F.col("piece").alias("fixed_piece"), "before", "end")


def recovered(transcripts: DataFrame, known: DataFrame) -> DataFrame:
    """Lines of ``transcripts`` (conv_id, place, part, line) with number, ``found_role`` and ``found_begin``.

    ``known`` are lines with role and begins, of any transcripts, that the model is fitted on.
    """
    model = fitted(state_counts(numbered(known)))
    roles = F.array(*[F.lit(role) for role, _ in STATES])
    states = decode(numbered(transcripts), model)
    return states.select(
        *[c for c in states.columns if c != "state"],
        F.element_at(roles, F.col("state") + 1).alias("found_role"),
        F.element_at(F.array(*[F.lit(begins) for _, begins in STATES]), F.col("state") + 1).alias("found_begin"),
    )


def rendered(line: F.Column, role: F.Column, begins: F.Column) -> F.Column:
    """A line in the canonical form: a turn's first line opens it and loses its marker."""
    spoken = F.regexp_replace(F.coalesce(line, F.lit("")), SPEAKER_PATTERN, "")
    return F.when(begins, F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), spoken)).otherwise(F.coalesce(line, F.lit("")))


def rendered_blocks(lines: DataFrame) -> DataFrame:
    """One row per (conv_id, place): the role of its first line, and its lines as canonical turns.

    A block that goes on with the turn before opens none; a turn that ends inside a block is closed there.
    """
    opens = F.col("found_begin") & (F.col("part") > 0)
    spoken = F.concat(F.when(opens, F.lit("<|im_end|>\n")).otherwise(F.lit("")), rendered(F.col("line"), F.col("found_role"), F.col("found_begin")))
    return (
        lines.withColumn("spoken", spoken)
        .groupBy("conv_id", "place")
        .agg(F.sort_array(F.collect_list(F.struct("part", "number", "spoken", "found_role", "found_begin"))).alias("lines"))
        .select(
            "conv_id",
            "place",
            F.element_at("lines", 1)["found_role"].alias("found_role"),
            F.element_at("lines", 1)["found_begin"].alias("found_begin"),
            F.size("lines").cast("long").alias("n_lines"),
            F.array_join(F.transform("lines", lambda line: line["spoken"]), "\n").alias("rendered"),
        )
    )


# Share of turns that are written down without a marker.
UNMARKED = 0.25


def written_down(conversations: DataFrame) -> DataFrame:
    """Conversations as transcript lines: markers in one style per conversation, some left out.

    ``role`` and ``begins`` stay beside the lines, for training and for comparison.
    """
    role = F.lower(F.col("role"))
    style = F.floor(unit_interval("style", F.col("conv_id")) * 5)
    other = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise(F.initcap(role))
    marker = (
        F.when(style == 0, F.concat(F.initcap(role), F.lit(": ")))
        .when(style == 1, F.concat(other, F.lit(": ")))
        .when(style == 2, F.concat(F.lit("["), role, F.lit("] ")))
        .when(style == 3, F.concat(F.lit("<|"), role, F.lit("|> ")))
        .otherwise(F.concat(F.lit("**"), F.initcap(role), F.lit(":** ")))
    )
    left_out = unit_interval("marker", F.col("conv_id"), F.col("turn")) < UNMARKED
    lines = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("place"), role.alias("role"),
        F.when(left_out, F.lit("")).otherwise(F.coalesce(marker, F.lit(""))).alias("marker"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("part", "words"),
    )
    begins = F.col("part") == 0
    return lines.select(
        "conv_id", "place", "part", F.concat(F.when(begins, F.col("marker")).otherwise(F.lit("")), "words").alias("line"), "role", begins.alias("begins")
    )
