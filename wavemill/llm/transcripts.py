"""Transcript parsing: a hidden Markov model recovers who speaks each line.

A state is a role with "first line of a turn" or "later line".  A line is seen as its speaker
marker (of which role, none, or blank line), whether it follows a blank line or begins a piece of
the transcript, its length class and whether it ends in a question mark.  Probabilities are counted from transcripts with known roles.
Viterbi finds the most likely states of a whole conversation, and each line that begins a turn is
rendered behind a canonical role mark, its own marker removed.

Rows are range-partitioned by (conversation, order), so a conversation of a third of all rows lies in
many partitions.  A partition sums up the run it shares with its neighbours as a table of best
scores from each state before the run to each state at its end; following these tables, of which a
partition has two at most, fixes the scores before and the state after every run, and then all
partitions are decoded at once.  The result is the Viterbi path of the whole conversation.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.session import materialize

ROLES = ("system", "user", "assistant")
#: Words that name a speaker at the start of a line.
SPEAKERS = {
    "system": ("system", "context", "instructions"),
    "user": ("user", "human", "q", "question", "customer"),
    "assistant": ("assistant", "ai", "bot", "a", "answer", "agent"),
}
MARKER = re.compile(
    r"\s*(?:[#>*\[(<|]{1,4}\s*)?(" + "|".join(sorted((w for ws in SPEAKERS.values() for w in ws), key=len, reverse=True))
    + r")\s*(?:\|>|[\])>*]{0,3}:[*]{0,2}|[\])>]{1,2}|$)\s*",
    re.I,
)
ROLE_OF = {w: k for k, role in enumerate(ROLES) for w in SPEAKERS[role]}
NONE, BLANK = 3, 4
#: Number of values of each feature of a line.
FEATURES = (5, 2, 3, 2)
STATES = 2 * len(ROLES)  # role * 2, plus 1 for later lines of a turn

PARSED = "conv_id long, turn long, roles array<string>, n_starts int, rendered string"


def describe(line: str, fresh: bool) -> tuple[tuple[int, ...], str]:
    """Feature values of a line, and the line without its speaker marker."""
    found = MARKER.match(line)
    marker = BLANK if not line.strip() else ROLE_OF[found[1].lower()] if found else NONE
    length = 0 if len(line) <= 40 else 1 if len(line) <= 160 else 2
    rest = line[found.end() :] if found else line
    return (marker, int(fresh), length, int(line.rstrip().endswith("?"))), rest


def symbols(text: str | None) -> list[tuple[tuple[int, ...], str]]:
    """(features, rest) of each line of a piece of a transcript."""
    out, fresh = [], True
    for line in (text or "").split("\n"):
        out.append(describe(line, fresh))
        fresh = out[-1][0][0] == BLANK
    return out


class Model:
    """Log probabilities; counts get one added, so nothing is impossible."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start = np.log(start / start.sum())
        self.step = np.log(step / step.sum(1, keepdims=True))
        self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in emit]

    def score(self, seen: tuple[int, ...]) -> np.ndarray:
        return sum(e[:, v] for e, v in zip(self.emit, seen))

    def table(self, run: list[tuple[int, ...]], first: np.ndarray) -> np.ndarray:
        """Best scores at the end of a run from rows of scores before it (or before the first line)."""
        m = first
        for seen in run:
            m = (m[:, :, None] + self.step).max(1) + self.score(seen)
        return m

    def begin(self, seen: tuple[int, ...]) -> np.ndarray:
        return self.start + self.score(seen)

    def path(self, run: list[tuple[int, ...]], before: np.ndarray | None, end: int | None) -> list[int]:
        """Best states of a run, given scores before it (None: it begins) and its last state (None: free)."""
        back, v = [], before
        for seen in run:
            if v is None:
                v, best = self.begin(seen), None
            else:
                every = v[:, None] + self.step
                best = every.argmax(0)
                v = every.max(0) + self.score(seen)
            back.append(best)
        states = [int(v.argmax()) if end is None else end]
        for best in back[:0:-1]:
            states.append(int(best[states[-1]]))
        return states[::-1]


def fit(known: DataFrame) -> Model:
    """Count a model from rows (conv_id, turn, role, text) of transcripts; unknown roles are not used.

    Rows meet their successor on (conv_id, turn), so no conversation is gathered.
    """
    index = {r: k for k, r in enumerate(ROLES)}
    rows = known.where(F.col("role").isin(*ROLES)).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")

    def count(batches):
        emit = [np.zeros((STATES, n)) for n in FEATURES]
        stay = np.zeros((STATES, 2))  # a later line follows, or not
        for batch in batches:
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                r = 2 * index[role]
                lines = symbols(text)
                for k, (seen, _) in enumerate(lines):
                    for e, v in zip(emit, seen):
                        e[r + (k > 0), v] += 1
                    stay[r + (k > 0), int(k + 1 < len(lines))] += 1
        flat = np.concatenate([stay.ravel(), *(e.ravel() for e in emit)])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat))), pa.array(flat)], ["at", "n"])

    total = np.zeros(STATES * 2 + STATES * sum(FEATURES))
    for r in rows.select("role", "text").mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    stay, emit, at = total[: 2 * STATES].reshape(STATES, 2) + 1, [], 2 * STATES
    for n in FEATURES:
        emit.append(total[at : at + STATES * n].reshape(STATES, n) + 1)
        at += STATES * n
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"))
    turns = np.ones((len(ROLES), len(ROLES)))
    for r in rows.join(after, ["conv_id", "turn"]).groupBy("role", "next").count().collect():
        turns[index[r["role"]], index[r["next"]]] += r["count"]
    start = np.full(STATES, 1e-3)
    for r in rows.where("turn = 0").groupBy("role").count().collect():
        start[2 * index[r["role"]]] += r["count"]
    step = np.full((STATES, STATES), 1e-9)
    for s in range(STATES):
        more = stay[s, 1] / stay[s].sum()
        step[s, s | 1] = more
        step[s, 0::2] = (1 - more) * turns[s // 2] / turns[s // 2].sum()
    return Model(start, step, emit)


def _runs(batches):
    """Rows of a sorted partition as (conv_id, [(turn, lines)]), one conversation after the other."""
    none = object()
    held, rows = none, []
    for batch in batches:
        for conv, turn, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "text"))):
            if conv != held:
                if held is not none:
                    yield held, rows
                held, rows = conv, []
            rows.append((turn, symbols(text)))
    if held is not none:
        yield held, rows


def parse(rows: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn, role of each line, turns begun and canonical text for every row.

    ``rows`` has pieces of transcripts (conv_id, turn, text), in order of ``turn``; where turns begin
    and who speaks is read from the lines alone.  A null text is one empty line, a null turn comes
    first, rows without conv_id are one conversation, repeated rows stay, an empty table gives no
    row; other columns are left out.
    """
    spark = rows.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pieces = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    pieces = pieces.withColumn("hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "hash", "tie"]
    ordered = materialize(pieces.repartitionByRange(count, *order).sortWithinPartitions(*order)).drop("hash", "tie")

    def summary(batches):
        from pyspark import TaskContext

        part, out, last = TaskContext.get().partitionId(), [], None
        for k, (conv, own) in enumerate(_runs(batches)):
            last = (conv, [seen for _, lines in own for seen, _ in lines])
            if k == 0:
                out.append(last)
        if last is not None and out[0] is not last:
            out.append(last)
        made = []
        for k, (conv, run) in enumerate(out):
            idle = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
            through = model.table(run, idle)
            begun = model.table(run[1:], model.begin(run[0])[None])[0]
            made.append((part, k, len(out), conv, through.ravel().tolist(), begun.tolist()))
        if made:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["part", "run", "runs", "conv_id", "through", "begun"]
            )

    found = ordered.mapInArrow(summary, "part int, run int, runs int, conv_id long, through array<double>, begun array<double>")
    links = follow(sorted(found.collect(), key=lambda r: (r["part"], r["run"])))  # two rows a partition

    def decode(batches):
        from pyspark import TaskContext

        part, k, out = TaskContext.get().partitionId(), 0, []
        runs = iter(_runs(batches))
        here = next(runs, None)
        while here is not None:
            after = next(runs, None)
            conv, own = here
            at = 0 if k == 0 else 1 if after is None else -1
            before, end = links.get((part, at), (None, None))
            states = model.path([seen for _, lines in own for seen, _ in lines], before, end)
            place = 0
            for turn, lines in own:
                named = states[place : place + len(lines)]
                place += len(lines)
                text = [f"<|{ROLES[s // 2]}|>\n{rest}" if s % 2 == 0 else rest for s, (_, rest) in zip(named, lines)]
                out.append((conv, turn, [ROLES[s // 2] for s in named], sum(s % 2 == 0 for s in named), "\n".join(text)))
            if len(out) > 5_000:
                yield batch_of(out)
                out = []
            here, k = after, k + 1
        if out:
            yield batch_of(out)

    return ordered.mapInArrow(decode, PARSED)


def batch_of(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "turn", "roles", "n_starts", "rendered"])


def follow(runs) -> dict[tuple[int, int], tuple[np.ndarray | None, int | None]]:
    """Scores before and state after each run that shares a conversation with another partition."""
    links, chain = {}, []

    def finish():
        if len(chain) < 2:
            return
        scores = [np.array(chain[0]["begun"])]
        for r in chain[1:]:
            scores.append((scores[-1][:, None] + np.array(r["through"]).reshape(STATES, STATES)).max(0))
        end = int(scores[-1].argmax())
        for k in range(len(chain) - 1, -1, -1):
            links[chain[k]["part"], chain[k]["run"]] = (scores[k - 1] if k else None, end)
            if k:
                end = int((scores[k - 1] + np.array(chain[k]["through"]).reshape(STATES, STATES)[:, end]).argmax())

    for r in runs:
        # Only a partition's last run and the next one's first can belong together.
        if chain and r["run"] == 0 and chain[-1]["conv_id"] == r["conv_id"]:
            chain.append(r)
        else:
            finish()
            chain = [r]
    finish()
    return links


def rendered_raw(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of conversations with known roles: (conv_id, turn, role, text).

    Each conversation has one of four styles of speaker marks; one turn in six has none.
    """
    style = F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(4))
    named = {"system": ("System: ", "[context] ", "### System:\n", "**System:** "), "user": ("User: ", "[human] ", "### Question:\n", "**Q:** ")}
    named["assistant"] = ("Assistant: ", "[ai] ", "### Answer:\n", "**A:** ")
    mark = F.lit("")
    for role, marks in named.items():
        for k, m in enumerate(marks):
            mark = F.when((F.col("role") == role) & (style == k), F.lit(m)).otherwise(mark)
    silent = (F.pmod(F.xxhash64("conv_id", "turn", F.lit(2)), F.lit(6)) == 0) & (F.col("turn") > 0)
    text = F.concat(F.when(silent, F.lit("")).otherwise(mark), F.coalesce(F.col("text"), F.lit("")))
    return conversations.select("conv_id", "turn", "role", text.alias("text"))
