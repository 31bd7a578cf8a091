"""Operator 1: token counts by a compiled finite-state tokenizer.

The tokenizer is compiled, lazily, into a deterministic transducer over
characters. A state holds what later characters can depend on: the last piece of
the encoding at each place a piece may still start from. A transition carries the
change of the number of emitted tokens. Before a blank that follows another
character the state is always the same, so the map of a chunk from entry state to
(exit state, count) is: the head before the first such place, the count behind
it, and the exit state. Maps compose associatively: chunks of a text are mapped
independently and combined by a prefix scan.
"""

from __future__ import annotations

import functools
import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillstream.llm.common import map_rows
from quillstream.llm.pieces import BPE, SPACE, PieceModel

#: Characters of a chunk, and the text length from which its chunks are spread over tasks.
CHUNK_CHARS = 1 << 18
SPREAD_CHARS = 1 << 22
#: The lazily built parts of the transducer are thrown away and rebuilt beyond these sizes.
MAX_STATES = 200_000
#: Words remembered in each of two generations, and the longest ones: together a bound in bytes.
MAX_WORDS = 700_000
MAX_CHARS = 64

#: No characters yet: the only place is the start itself.
START = ("", ((0, None, 0),))


class Transducer:
    """States are interned; ``arcs[state][character]`` is (next state, change of the count)."""

    def __init__(self, model: PieceModel):
        if model.kind != BPE:
            raise ValueError("a transducer is compiled for BPE models")
        self.model = model
        self.words: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.keys: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.arcs: list[dict] = []

    def number(self, key: tuple) -> int:
        found = self.numbers.get(key)
        if found is None:
            found = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.arcs.append({})
        return found

    def _compile(self, key: tuple, ch: str) -> tuple[tuple, int]:
        """``key`` holds the text that pieces may still start in and, nearest last, each place in it that a
        longer piece may start from: its distance from the end, the last piece up to it, and the count there
        relative to the count at the end."""
        model, (tail, places) = self.model, key
        if ch == SPACE and places[-1][1] is not None and places[-1][1][-1] != SPACE:
            tail, places = START
        grown = tail + ch
        for back, before, count in places:
            piece = grown[len(grown) - back - 1:]
            if (back == 0 or piece in model.ids) and model.follows(before, piece):
                delta = count + model.cost(piece)
                break
        kept = [(d + 1, p, n - delta) for d, p, n in places if grown[len(grown) - d - 1:] in model.growing]
        return (grown[len(grown) - kept[0][0]:] if kept else "", (*kept, (0, piece, 0))), delta

    def run(self, key: tuple, text: str) -> tuple[tuple, int]:
        """Exit state and change of the count over ``text``."""
        if len(self.keys) > MAX_STATES:
            self._reset()
        state, total, arcs = self.number(key), 0, self.arcs
        for ch in text:
            arc = arcs[state].get(ch)
            if arc is None:
                after, delta = self._compile(self.keys[state], ch)
                arc = arcs[state][ch] = (self.number(after), delta)
            state = arc[0]
            total += arc[1]
        return self.keys[state], total

    def word(self, word: str) -> int:
        """A word from start to start: one transition with its whole count."""
        count = self.words.get(word)
        if count is None:
            count = self.before.get(word)
            if count is None:
                count = self.run(START, SPACE + word)[1]
            if len(word) <= MAX_CHARS:
                if len(self.words) >= MAX_WORDS:
                    self.words, self.before = {}, self.words
                self.words[word] = count
        return count

    def chunk_map(self, chunk: str) -> dict:
        """The state map of a chunk of escaped text."""
        cut = _first_word(chunk)
        if cut is None:
            return {"head": chunk, "closed": False, "count": 0, "exit": None}
        body = chunk[cut:]
        last = body.rfind(SPACE)
        while last > 0 and body[last - 1] == SPACE:
            last -= 1
        total = self._whole(body[:last]) if last > 0 else 0
        key, count = self.run(START, body[max(last, 0):])
        return {"head": chunk[:cut], "closed": True, "count": total + count, "exit": key}

    def _whole(self, body: str) -> int:
        """Count of escaped text that starts with a blank and is followed by one."""
        parts = body[1:].split(SPACE)
        if "" not in parts:
            total, word = 0, self.word
            for p in parts:
                count = self.words.get(p)
                total += word(p) if count is None else count
            return total
        total, blanks = 0, 0
        for part in parts:
            if part:
                total += self.word(SPACE * blanks + part) if blanks else self.word(part)
                blanks = 0
            else:
                blanks += 1
        return total + (self.run(START, SPACE * (blanks + (not any(parts))))[1] if blanks else 0)

    def compose(self, left: dict, right: dict) -> dict:
        """The map of two chunks in a row."""
        if not left["closed"]:
            cut = _first_word(left["head"] + right["head"])
            if cut is not None:  # the seam itself closes the head
                joint = self.chunk_map(left["head"] + right["head"])
                return self.compose(joint, {**right, "head": ""}) if right["closed"] else joint
            return {**right, "head": left["head"] + right["head"]}
        key, delta = self.run(left["exit"], right["head"])
        if not right["closed"]:
            return {**left, "count": left["count"] + delta, "exit": key}
        return {"head": left["head"], "closed": True, "count": left["count"] + delta + right["count"], "exit": right["exit"]}

    def total(self, whole: dict) -> int:
        return self.run(START, whole["head"])[1] + whole["count"]

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        escaped = self.model.escaped(text)
        maps = [self.chunk_map(escaped[i:i + chunk_chars]) for i in range(0, len(escaped), chunk_chars)]
        return self.total(reduce(self.compose, maps)) if maps else 0


def _first_word(text: str) -> int | None:
    """First place at which a blank follows another character."""
    at = text.find(SPACE, 1)
    while at > 0:
        if text[at - 1] != SPACE:
            return at
        at = text.find(SPACE, at + 1)
    return None


@functools.lru_cache(maxsize=2)
def compiled(model_path: str) -> Transducer:
    """One transducer for each model and Python worker, whose later tasks find what earlier ones have compiled."""
    return Transducer(PieceModel.load(model_path))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, spread_chars: int = SPREAD_CHARS,
                 chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    A null text counts as empty: no bytes, no tokens. Rows with equal or null
    doc_id are counted one by one; other columns are ignored. Texts above
    ``spread_chars`` are cut, their chunks mapped by different tasks and composed
    per text; only such chunks are shuffled.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    big = F.length("text") > spread_chars
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint"

    def make():
        machine = compiled(model_path)

        def work(c):
            return {"doc_id": c["doc_id"], "n_bytes": c["n_bytes"], "n_tokens": [machine.count(t, chunk_chars) for t in c["text"]]}
        return work

    short = map_rows(rows.where(~big).select("doc_id", "text", F.octet_length("text").cast("bigint").alias("n_bytes")), make, schema)

    def cut():
        model = PieceModel.load(model_path)

        def work(c):
            out = {k: [] for k in ("row", "doc_id", "n_bytes", "chunk", "text")}
            for row, doc, text in zip(c["row"], c["doc_id"], c["text"]):
                size, escaped = len(text.encode()), model.escaped(text)
                for k, at in enumerate(range(0, len(escaped), chunk_chars)):
                    for name, value in zip(out, (row, doc, size, k, escaped[at:at + chunk_chars])):
                        out[name].append(value)
            return out
        return work

    def map_chunks():
        machine = compiled(model_path)

        def work(c):
            return {**c, "map": [json.dumps(machine.chunk_map(t)) for t in c["text"]]}
        return work

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        machine = compiled(model_path)
        maps = [_loaded(m) for m in group.sort_values("chunk")["map"]]
        first = group.iloc[:1]
        return pd.DataFrame({"doc_id": first["doc_id"], "n_bytes": first["n_bytes"], "n_tokens": [machine.total(reduce(machine.compose, maps))]})

    long = rows.where(big).withColumn("row", F.monotonically_increasing_id())
    chunks = map_rows(long, cut, "row bigint, doc_id bigint, n_bytes bigint, chunk bigint, text string", rows=1)
    mapped = map_rows(chunks.repartition("row", "chunk"), map_chunks, "row bigint, doc_id bigint, n_bytes bigint, chunk bigint, map string", rows=8)
    counted = short.unionByName(mapped.groupBy("row").applyInPandas(fold, schema))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def _loaded(text: str) -> dict:
    value = json.loads(text)
    if value["exit"] is not None:
        tail, places = value["exit"]
        value["exit"] = (tail, tuple(map(tuple, places)))
    return value
