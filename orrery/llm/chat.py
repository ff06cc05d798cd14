"""Chat formatting: minimum-cost role repair over an automaton of legal turns.

Legal conversations are an optional system message, then user and assistant in
turn. Each turn is kept, relabelled or merged into the message before, and empty
messages may be inserted; dynamic programming over the automaton's states finds
the repair of least cost. Among repairs of equal cost a small number per turn and
state, hashed from the turn, decides, so that the choice does not depend on how
the rows are dealt.

A turn's step is a matrix of costs between states, and steps compose by
(min, +) products. So turns are dealt by range of (conversation, turn) and cut
into blocks of ``BLOCK`` turns; a conversation of any length is spread over tasks.
Each block has the product of what lies before it within its partition, each
segment (a conversation's part of a partition) the products of what follows each
block. Only segments at a partition's edges, two each, are combined further, one
row each. Then every block is repaired on its own, with the same result as the
whole conversation in one piece.

Result: one row per turn with its role in the repaired sequence and its rendered
piece; the pieces of a conversation in order are its text. Edge cases: null or
unknown roles are relabelled at the cost of ``RELABEL``; a null text is empty; a
null turn comes first; equal turns are ordered by a hash of role and text, and
repeated rows stay; rows with a null conversation form one conversation; an empty table gives
no rows; other columns are not read. Marks within texts are defused.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.shared import checkpointed

BLOCK = 256
RELABEL, MERGE, INSERT = 2.0, 1.0, 3.0
#: More for making a system message of another.
TO_SYSTEM = 3.0
ROLES = ("", "system", "user", "assistant")
ALIASES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: From each state (0: begin) the roles that a next message may have.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ENDS = (2, 3)
#: Costs are integers in units of SCALE, with ties of 16 bits below; only differences
#: between states matter, so products are reduced by their least entry and stay small.
SCALE, FAR = 1 << 48, 1 << 60
START = np.array([0, FAR, FAR, FAR])
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def state_of(role: str | None) -> int:
    """1 to 3 for a known role, 0 for any other."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else 0


@lru_cache(maxsize=8)
def step(role: int) -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, int, float]]]:
    """Scaled costs from state to state for a turn of ``role``; (action, inserted role, cost) of each."""
    cost, how = np.full((4, 4), FAR), {}

    def offer(a: int, b: int, price: float, action: str, inserted: int) -> None:
        price += (RELABEL + TO_SYSTEM * (b == 1)) * (role != b)
        if price * SCALE < cost[a, b]:
            cost[a, b] = int(price * SCALE)
            how[a, b] = (action, inserted, price)

    for a in range(4):
        for b in NEXT[a]:
            offer(a, b, 0, "message", 0)
        if a:
            offer(a, a, MERGE, "merge", 0)
        for middle in NEXT[a]:
            for b in NEXT[middle]:
                offer(a, b, INSERT, "message", middle)
    return cost, how


def costs_of(turn: dict) -> np.ndarray:
    """The turn's matrix, ties included."""
    seed = f"{turn['turn']}\0{turn['role']}\0{turn['text']}".encode("utf-8", "surrogatepass")
    ties = np.frombuffer(blake2b(seed, digest_size=8).digest(), np.uint16).astype(np.int64)
    return np.minimum(step(state_of(turn["role"]))[0] + ties, FAR)


def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """(min, +) product, less its least entry; ``first`` may be a vector."""
    out = (first[..., :, None] + second).min(axis=-2)
    return np.where(out >= FAR, FAR, out - out.min())


UNIT = np.where(np.eye(4, dtype=bool), 0, FAR)


def product(turns: list[dict]) -> np.ndarray:
    out = UNIT
    for t in turns:
        out = then(out, costs_of(t))
    return out


def repaired(turns: list[dict], begin: np.ndarray, end: int) -> list[tuple[int, int, str, int, float]]:
    """(state before, state, action, inserted role, cost) per turn, from costs ``begin`` to state ``end``."""
    steps = [costs_of(t) for t in turns]
    costs = [begin]
    for m in steps:
        costs.append(then(costs[-1], m))
    out, state = [], end
    for i in range(len(turns) - 1, -1, -1):
        before = int((costs[i] + steps[i][:, state]).argmin())
        action, inserted, price = step(state_of(turns[i]["role"]))[1][before, state]
        out.append((before, state, action, inserted, price))
        state = before
    return out[::-1]


def best_end(costs: np.ndarray) -> int:
    """The cheapest state in which a conversation may end."""
    return min(ENDS, key=lambda s: (costs[s], s))


def render(text: str, before: int, state: int, action: str, inserted: int, last: bool) -> str:
    text = text.replace("<|im_", "<im_")
    if action == "merge":
        out = "\n" + text
    else:
        out = CLOSE if before else ""
        if inserted:
            out += f"{OPEN}{ROLES[inserted]}\n{CLOSE}"
        out += f"{OPEN}{ROLES[state]}\n{text}"
    return out + CLOSE * last


BLOCKS = pa.schema([
    ("key", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_()),
    ("turns", pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))),
    ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64())),
])
BLOCKS_DDL = "key string, part int, block int, whole boolean, turns array<struct<turn:bigint,role:string,text:string>>, before array<long>, after array<long>"


def cut(batches, block: int):
    """Block rows (turns, product before) and segment rows (block -1; products from each block's end, then the whole)."""
    part = TaskContext.get().partitionId()
    key, turns, products, first_key = None, [], [], True
    out: list[dict] = []

    def close(whole: bool) -> None:
        nonlocal turns
        if turns:
            before = UNIT
            if products:
                before = then(products[-1][0], products[-1][1])
            products.append((before, product(turns)))
            out.append({"key": key, "part": part, "block": len(products) - 1, "whole": whole, "turns": turns, "before": before.ravel().tolist(), "after": None})
            turns = []

    def finish(edge: bool) -> None:
        whole = not edge and not products
        close(whole)
        if whole:
            return
        after, rest = [], UNIT
        for _, own in reversed(products):
            after.append(rest)
            rest = then(own, rest)
        flat = np.stack([*after[::-1], rest]).ravel().tolist()
        out.append({"key": key, "part": part, "block": -1, "whole": False, "turns": None, "before": None, "after": flat})

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != key:
                if key is not None:
                    finish(first_key)
                    first_key = False
                key, products = row["key"], []
            turns.append({"turn": row["turn"], "role": row["role"], "text": row["text"]})
            if len(turns) == block:
                close(False)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=BLOCKS)
            out.clear()
    if key is not None:
        finish(True)
        yield pa.RecordBatch.from_pylist(out, schema=BLOCKS)


def linked(groups):
    """Per conversation: each segment's costs at its begin and state at its end."""
    for pdf in groups:
        rows = {"key": [], "part": [], "enter": [], "leave": [], "last": []}
        for key, parts in zip(pdf["key"], pdf["parts"], strict=True):
            parts = sorted((p["part"], p["whole"]) for p in parts)
            whole = [np.array(a).reshape(4, 4) for _, a in parts]
            enter = [START]
            for m in whole:
                enter.append(then(enter[-1], m))
            state = best_end(enter[-1])
            leave = []
            for i in range(len(parts) - 1, -1, -1):
                leave.append(state)
                state = int((enter[i] + whole[i][:, state]).argmin())
            for i, (part, _) in enumerate(parts):
                for c, v in zip(rows, (key, part, enter[i].tolist(), leave[-1 - i], i == len(parts) - 1), strict=True):
                    rows[c].append(v)
        yield type(pdf)(rows)


def formatted(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """key, turn, role, role_out, action, inserted, cost, rendered: one row per turn."""
    rows = turns.select(
        F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")).alias("key"),
        F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    # equal turns are dealt apart by the hash, so that no bound cuts through a conversation's order
    ranged = rows.repartitionByRange("key", "turn", "tie").sortWithinPartitions("key", "turn", "tie", "role", "text")
    both = checkpointed(ranged.mapInArrow(lambda batches: cut(batches, block), BLOCKS_DDL), "blocks")
    segments = both.where("block = -1").select("key", "part", "after")
    # of a segment the product of all its turns alone: 16 numbers, whatever its length
    wholes = segments.groupBy("key").agg(F.collect_list(F.struct("part", F.slice("after", -16, 16).alias("whole"))).alias("parts"))
    links = wholes.mapInPandas(linked, "key string, part int, enter array<long>, leave int, last boolean")
    links = checkpointed(links.join(segments.withColumnRenamed("after", "rest"), ["key", "part"]), "segments")
    own = both.where("block >= 0").join(links, ["key", "part"], "left")

    def repair(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = r["turns"]
                if r["whole"]:
                    enter, last = START, True
                    end = best_end(then(START, product(own)))
                else:
                    enter = then(np.array(r["enter"]), np.array(r["before"]).reshape(4, 4))
                    rest = np.array(r["rest"]).reshape(-1, 4, 4)
                    end = int((then(enter, product(own)) + rest[r["block"]][:, r["leave"]]).argmin())
                    last = r["last"] and r["block"] == len(rest) - 2
                for i, (t, (before, state, action, inserted, cost)) in enumerate(zip(own, repaired(own, enter, end), strict=True)):
                    out.append({
                        "key": r["key"], "turn": t["turn"], "role": t["role"], "role_out": ROLES[state], "action": action,
                        "inserted": ROLES[inserted] or None, "cost": cost,
                        "rendered": render(t["text"], before, state, action, inserted, last and i == len(own) - 1),
                    })
            yield pa.RecordBatch.from_pylist(out, schema=TURNS)

    done = own.select("key", "block", "whole", "turns", "before", "enter", "leave", "last", "rest").mapInArrow(repair, TURNS_DDL)
    kind = dict(turns.dtypes)[key]
    value = F.when(F.col("key") != "", F.expr("substring(key, 2)").cast(kind)).alias(key)
    return done.select(value, F.col("turn").alias(turn), F.col("role").alias(role), "role_out", "action", "inserted", "cost", "rendered")


TURNS = pa.schema([(c, pa.string()) for c in ("key",)] + [("turn", pa.int64())] + [(c, pa.string()) for c in ("role", "role_out", "action", "inserted")] + [("cost", pa.float64()), ("rendered", pa.string())])
TURNS_DDL = "key string, turn long, role string, role_out string, action string, inserted string, cost double, rendered string"


def op9(conversations: DataFrame) -> DataFrame:
    return formatted(conversations)
