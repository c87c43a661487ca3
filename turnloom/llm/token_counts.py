"""Token counts of whole texts by a byte-level BPE tokenizer compiled to finite-state transducers.

Two deterministic machines run one after the other, both as table look-ups on whole arrays:

* `Splitter` reads characters (their class, and the class of the next one) and marks where the pieces
  of the split pattern begin. Its state maps form a finite monoid, closed once into a multiplication
  table. A block of text is cut into chunks; all chunks run in step and yield one state map for each
  character, a parallel prefix scan composes the chunks' maps, and the scan's states decide the marks.
* `Merges` reads the bytes of a piece. Its transitions carry the number of tokens that are settled by
  the byte. A state holds, for each unfinished token that the last bytes may begin, the trie node
  reached, the merges that the token before it forbids, and the tokens by which it lies ahead of the
  least. Two neighbouring tokens stand in the output exactly if no merge across their border comes
  before either side is merged away; so this is all that decides what follows. States are compiled when
  first met, and the table is started anew when it passes `STATES`. Pieces longer than a chunk are cut
  too: all chunks run from guessed states, and those whose guess was not the state in which the chunk
  before ended run again, until all maps fit together.

A block holds `BLOCK` characters; what is open at its end (two states) goes on into the next, so a text
of any length needs the memory of one block. Special tokens that the file declares count as one token
and end a piece, as the library has it.

Defined results: a null text is the empty text (0 bytes, 0 tokens); a null key stays; repeated rows
give repeated rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import keyed, small

BLOCK, LANE, CHUNK = 1 << 18, 128, 64
STATES = 1 << 16

LETTER, SINGLE, R, V, L, E, NUMBER, BLANK, WHITE, SIGN, QUOTE, END = range(12)
_CLASSES = 12
_END_CODE = 0x110000  # stands between texts; no character has it
START, LETTERS, NUMBERS, SIGNS, SPACED, WHITES, SUFFIX, BEFORE_E, BEFORE_L = range(9)


def _step(state: int, this: int, after: int) -> tuple[int, bool]:
    """The split pattern of byte-level BPE: next state, and whether a piece begins at this character."""
    if this == END:
        return START, False
    letter, white = this <= E, this in (BLANK, WHITE)
    if state == SUFFIX:
        return START, False
    if (state == BEFORE_E and after == E) or (state == BEFORE_L and this == after == L):
        return SUFFIX, False
    if white:
        if after in (BLANK, WHITE):
            return WHITES, state != WHITES
        if after == END:
            return START, state != WHITES
        return (SPACED if this == BLANK else START), True  # a run leaves its last character to what follows
    if state == SPACED:
        return (LETTERS if letter else NUMBERS if this == NUMBER else SIGNS), False
    if letter:
        return LETTERS, state != LETTERS
    if this == NUMBER:
        return NUMBERS, state != NUMBERS
    if state == SIGNS:
        return SIGNS, False
    if this == QUOTE and after == SINGLE:
        return SUFFIX, True
    if this == QUOTE and after in (R, V):
        return BEFORE_E, True
    if this == QUOTE and after == L:
        return BEFORE_L, True
    return SIGNS, True


class Classes:
    """Classes of characters, by the tokenizer library's own expressions, asked when first met."""

    def __init__(self) -> None:
        self.known = np.full(_END_CODE + 1, _CLASSES, np.uint8)
        for kind, characters in ((SINGLE, "stmd"), (R, "r"), (V, "v"), (L, "l"), (E, "e"), (BLANK, " "), (QUOTE, "'")):
            self.known[[ord(c) for c in characters]] = kind
        self.known[_END_CODE] = END

    def of(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.known[codes]
        if (kinds == _CLASSES).any():
            self._ask(np.unique(codes[kinds == _CLASSES]))
            kinds = self.known[codes]
        return kinds

    def _ask(self, new: np.ndarray) -> None:
        from tokenizers import Regex, pre_tokenizers

        text = new.astype("<u4").tobytes().decode("utf-32-le")
        self.known[new] = SIGN
        for kind, expression in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            holds = np.ones(len(new), bool)
            for _, (start, end) in pre_tokenizers.Split(Regex(expression), "removed").pre_tokenize_str(text):
                holds[start:end] = False
            self.known[new[holds]] = kind


class Splitter:
    """Marks the beginnings of pieces."""

    def __init__(self) -> None:
        symbols = [(a, b) for a in range(_CLASSES) for b in range(_CLASSES)]
        steps = [[_step(s, a, b) for s in range(9)] for a, b in symbols]
        self.marks = np.array([[m for _, m in row] for row in steps], bool)
        generators = [tuple(s for s, _ in row) for row in steps]
        maps: dict[tuple[int, ...], int] = {tuple(range(9)): 0}  # the identity and all products of steps
        order = list(maps)
        for known in order:
            for g in set(generators):
                product = tuple(g[s] for s in known)
                if product not in maps:
                    maps[product] = len(order)
                    order.append(product)
        self.apply = np.array(order, np.uint8)
        self.after = np.array([[maps[tuple(g[s] for s in known)] for g in generators] for known in order], np.uint16)
        self.product = np.array([[maps[tuple(b[s] for s in a)] for b in order] for a in order], np.uint16)

    def run(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Marks of all characters and the state at the end, from `state`."""
        n = len(symbols)
        lanes = -(-n // LANE)
        steps = np.zeros(lanes * LANE, np.uint8)
        steps[:n] = symbols
        steps = np.ascontiguousarray(steps.reshape(lanes, LANE).T)
        maps = np.zeros((LANE + 1, lanes), np.uint16)  # before each character, of its chunk so far
        for i in range(LANE):
            maps[i + 1] = self.after[maps[i], steps[i]]
        upto, reach = maps[LANE].copy(), 1
        while reach < lanes:  # parallel prefix scan over the chunks' maps
            upto[reach:] = self.product[upto[:-reach], upto[reach:]]
            reach *= 2
        entry = np.r_[np.uint8(state), self.apply[upto[:-1], state]]
        states = self.apply[maps, entry[None, :]]
        marks = self.marks[steps, states[:LANE]].T.reshape(-1)[:n]
        at, lane = (n - 1) % LANE + 1, (n - 1) // LANE
        return marks, int(states[at, lane])


class Merges:
    """Counts the tokens of pieces."""

    def __init__(self, vocabulary: dict[str, int], merges: list) -> None:
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in vocabulary if all(c in letters for c in t)}
        self.parts: dict[bytes, tuple[bytes, bytes, int]] = {}
        self.right_of: dict[bytes, list[tuple[bytes, int]]] = {}
        for rank, pair in enumerate(merges):
            left, right = (raw[p] for p in (pair.split(" ") if isinstance(pair, str) else pair))
            for part in (left, right):
                if len(part) > 1 and part not in self.parts:
                    raise ValueError(f"merge {rank} comes before the merge that makes {part!r}")
            if left + right in self.parts:
                raise ValueError(f"two merges make {left + right!r}")
            self.parts[left + right] = (left, right, rank)
            self.right_of.setdefault(left, []).append((right, rank))
        self.last = len(merges)
        tokens = {bytes([b]) for b in range(256)} | set(self.parts)
        self.nodes: dict[bytes, int] = {b"": 0}
        for token in sorted(tokens):
            for end in range(1, len(token) + 1):
                self.nodes.setdefault(token[:end], len(self.nodes))
        self.text = list(self.nodes)
        inner = {t[:-1] for t in self.nodes if t}
        self.inner = [t in inner for t in self.nodes]
        self.is_token = [t in tokens for t in self.nodes]
        self.left_edge = functools.lru_cache(maxsize=1 << 15)(self._left_edge)
        self.clear()

    def clear(self) -> None:
        """Forget all compiled states but the first: nothing read, nothing open."""
        self.forbids: dict[tuple, int] = {}
        self.sets: list[dict[bytes, int]] = []
        self._after_token: dict[int, int] = {}
        self._narrowed: dict[tuple[int, int], int] = {}
        self.states: dict[tuple, int] = {}
        self.known: list[tuple] = []
        self.table = np.full(256 * 1024, -1, np.int32)  # next state * 256 + tokens settled
        self.rest = np.zeros(1024, np.int16)  # tokens still to come if the piece ends here
        self._number(((0, self._intern({}), 0),))

    def _left_edge(self, token: bytes) -> tuple[tuple[bytes, int], ...]:
        """Pieces that stand at the token's left edge while it is merged, with the merge that takes each."""
        edge, taken = [], self.last
        while True:
            edge.append((token, taken))
            if len(token) == 1:
                return tuple(edge)
            token, _, taken = self.parts[token]

    def _forbidden_after(self, token: bytes) -> dict[bytes, int]:
        """Piece -> earliest merge that would join it to the right edge of `token`."""
        found: dict[bytes, int] = {}
        taken = self.last
        while True:
            for right, rank in self.right_of.get(token, ()):
                if rank < taken:
                    found[right] = min(rank, found.get(right, rank))
            if len(token) == 1:
                return found
            _, token, taken = self.parts[token]

    def _intern(self, forbidden: dict[bytes, int]) -> int:
        key = tuple(sorted(forbidden.items()))
        if key not in self.forbids:
            self.forbids[key] = len(self.sets)
            self.sets.append(forbidden)
        return self.forbids[key]

    def _after(self, node: int) -> int:
        if node not in self._after_token:
            self._after_token[node] = self._intern(self._forbidden_after(self.text[node]))
        return self._after_token[node]

    def _narrow(self, forbidden: int, node: int) -> int:
        """What still matters of `forbidden` once the next token is known to begin with the node's text."""
        key = (forbidden, node)
        if key not in self._narrowed:
            start = self.text[node]
            self._narrowed[key] = self._intern({
                y: m for y, m in self.sets[forbidden].items() if y.startswith(start) or start.startswith(y)})
        return self._narrowed[key]

    def _number(self, state: tuple) -> int:
        """`state`: (node, forbidden, tokens before) for each open token; the least count is 0."""
        if state not in self.states:
            number = self.states[state] = len(self.known)
            self.known.append(state)
            if number >= len(self.rest):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, np.int32)])
                self.rest = np.concatenate([self.rest, np.zeros_like(self.rest)])
            self.rest[number] = next(count for node, _, count in state if node == 0)
        return self.states[state]

    def _compile(self, key: int) -> None:
        """One transition. Of the tokens that could end here exactly one fits what precedes it."""
        byte, found = bytes([key & 255]), []
        for node, forbidden, count in self.known[key >> 8]:
            child = self.nodes.get(self.text[node] + byte)
            if child is None:
                continue
            if self.is_token[child]:
                never = self.sets[forbidden]
                if all(never.get(y, self.last + 1) > taken for y, taken in self.left_edge(self.text[child])):
                    found.append((0, self._after(child), count + 1))
            if self.inner[child]:
                found.append((child, self._narrow(forbidden, child), count))
        settled = min(count for _, _, count in found)
        state = self._number(tuple(sorted((node, f, count - settled) for node, f, count in found)))
        self.table[key] = state << 8 | settled

    def run(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple:
        """State at the end and tokens settled for stretches of `data`, all in step."""
        order = np.argsort(-length, kind="stable")
        begin, state = start[order], entry[order].astype(np.int64)
        settled = np.zeros(len(start), np.int64)
        active = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), "left")
        for i, n in enumerate(active):
            key = state[:n] << 8 | data[begin[:n] + i]
            move = self.table[key]
            if move.min() < 0:
                for missing in np.unique(key[move < 0]):
                    self._compile(int(missing))
                move = self.table[key]
            settled[:n] += move & 255
            state[:n] = move >> 8
        out = np.empty_like(state), np.empty_like(settled)
        out[0][order], out[1][order] = state, settled
        return out

    def pieces(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, first: int) -> tuple:
        """As `run` for whole pieces of which the first goes on from state `first`."""
        parts = np.maximum(1, -(-length // CHUNK))
        head = np.cumsum(parts) - parts
        within = np.arange(parts.sum()) - np.repeat(head, parts)
        begin = np.repeat(start, parts) + within * CHUNK
        span = np.minimum(CHUNK, np.repeat(length, parts) - within * CHUNK)
        entry = np.zeros(len(begin), np.int64)
        entry[:1] = first
        state, settled = self.run(data, begin, span, entry)
        inner = np.flatnonzero(within > 0)
        while len(wrong := inner[entry[inner] != state[inner - 1]]):
            entry[wrong] = state[wrong - 1]
            state[wrong], settled[wrong] = self.run(data, begin[wrong], span[wrong], entry[wrong])
        return state[head + parts - 1], np.add.reduceat(settled, head) if len(head) else settled


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, all other bytes for the characters from 256 on."""
    own = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenCounter:
    """Token counts of texts, by both machines."""

    def __init__(self, path: str, block: int = BLOCK, states: int = STATES) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, model = spec["pre_tokenizer"], spec["model"]
        if (spec.get("normalizer") or split["type"] != "ByteLevel" or split["add_prefix_space"]
                or not split.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges")):
            raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
        added = spec.get("added_tokens") or []
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError(f"{path} has special tokens that take more than their own characters")
        longest = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest)) or r"(?!)")
        self.classes, self.splitter = Classes(), Splitter()
        self.merges = Merges(model["vocab"], model["merges"])
        self.block, self.limit = block, states

    def _segments(self, texts: list[str], counts: np.ndarray) -> Iterator[tuple[int, str]]:
        """Stretches without special tokens, of `block` characters at most; None ends a text's stretch."""
        for i, text in enumerate(texts):
            at = 0
            for hit in self.special.finditer(text):
                counts[i] += 1
                yield i, text[at:hit.start()]
                at = hit.end()
            yield i, text[at:] if at else text

    def _blocks(self, texts: list[str], counts: np.ndarray) -> Iterator[tuple[list[str], list[int]]]:
        """Runs of (part, owner) of about `block` characters; a part with owner -1 - i goes on in the next block."""
        parts, owners, size = [], [], 0
        for i, segment in self._segments(texts, counts):
            at = 0
            while size + len(segment) - at >= self.block:
                cut = at + self.block - size
                yield [*parts, segment[at:cut]], [*owners, -1 - i]
                parts, owners, size, at = [], [], 0, cut
            if at < len(segment):
                parts.append(segment[at:]), owners.append(i)
                size += len(segment) - at
            elif at:  # the stretch ended with the block
                parts.append(""), owners.append(i)
        if parts:
            yield parts, owners

    def counts(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        split, piece, held = START, 0, ""  # a character is held back until the next one is known
        for parts, owners in self._blocks(texts, counts):
            goes_on = owners[-1] < 0
            owners = [o if o >= 0 else -1 - o for o in owners]
            parts[0] = held + parts[0]
            held = ""
            if goes_on:
                parts[-1], held = parts[-1][:-1], parts[-1][-1:]
            codes = np.full(sum(map(len, parts)) + len(parts), _END_CODE, np.uint32)
            at, ends = 0, []
            for part in parts:
                codes[at:at + len(part)] = np.frombuffer(part.encode("utf-32-le"), "<u4")
                at += len(part) + 1
                ends.append(at)
            if goes_on:
                codes[-1] = ord(held)
            kinds = self.classes.of(codes)
            after = np.r_[kinds[1:], np.uint8(END)]
            n = len(codes) - 1 if goes_on else len(codes)
            marks, split = self.splitter.run((kinds * _CLASSES + after)[:n], split) if n else (np.zeros(0, bool), split)
            codes = codes[:n]
            width = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
            width[codes == _END_CODE] = 0
            offset = np.cumsum(width, dtype=np.int64) - width
            data = np.frombuffer("".join(parts).encode(), np.uint8)
            # the first stretch goes on with the piece left open, which may be empty
            begins = np.flatnonzero(marks)
            start = np.r_[0, offset[begins]]
            length = np.diff(np.r_[start, len(data)])
            state, settled = self.merges.pieces(data, start, length, piece)
            owner = np.asarray(owners)[np.searchsorted(np.asarray(ends), np.r_[0, begins], "right").clip(max=len(owners) - 1)]
            np.add.at(counts, owner, settled)
            is_open = goes_on and (len(parts) == 1 or parts[-1] != "")  # else all before the held character has ended
            closed = slice(None, -1) if is_open else slice(None)
            np.add.at(counts, owner[closed], self.merges.rest[state[closed]])
            piece = int(state[-1]) if is_open else 0
            if len(self.merges.known) > self.limit:
                kept = [(self.merges.text[node], self.merges.sets[f], count) for node, f, count in self.merges.known[piece]]
                self.merges.clear()
                piece = self.merges._number(tuple(sorted(
                    (self.merges.nodes[t], self.merges._intern(f), count) for t, f, count in kept)))
        return counts


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    """One compiled tokenizer per Python worker."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text; rows are mapped where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = counter(path)
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            yield pa.record_batch([batch.column("key"), batch.column("n_bytes"), pa.array(machine.counts(texts))],
                                  names=["key", "n_bytes", "n_tokens"])

    rows = keyed(docs, key, text).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "key long, n_bytes long, n_tokens long").select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
