"""BPE encoding and decoding by a deterministic automaton compiled from the merges.

First an automaton over tokens: a path spells exactly the token sequences that BPE produces. It starts with one state and an
arc for each byte. Each merge (u, v), in order, adds a gadget: all arcs labelled u lead from now on to states that have no
arc v, and every state from which u and then v could be read gets an arc uv to where v led. The state after a token depends
on the token alone, and differs from the one it was copied from by the gadgets added since, so rows of arcs are kept as those
differences, in arrays by token (``left``, ``right``, ``rank``) and a table of pairs; ``Automaton.follows`` reads a row.

Then the automaton over bytes: spelling out each arc, and making the result deterministic. A state is the set of arcs that
may be under way (the token before, and how far the arc is spelled); its label is the token that ends here, of which there is
always exactly one. All states that the labels of the vocabulary lead through are compiled once, by one task, into a
transition table; states that only other words lead to are added to a worker's table as they are met, and dropped again
when there are ``MORE_STATES`` of them. A word is encoded by one transition a byte; the tokens are then read off backwards,
from the label of the last state. Decoding emits the labels of the arcs, token by token.

The tables' size is that of the vocabulary file, whatever the corpus; they are broadcast, and executors never open the file.
Words are cached, so most of what a text needs is one lookup a word.

Cases: null is encoded like the empty text: no tokens; special tokens in a text become their ids, as the tokenizers
library has it; texts and words of any length take time in proportion to their length; repeated rows are encoded each by
itself; an empty table gives no rows; the columns of the input stay, but for one named like the output.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evoked.llm.common import table

#: Fixed: how byte-level BPE splits texts; L, N and S stand for the classes of letters, numbers and white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[L]+| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
#: Words, and as many pieces, that a Python worker keeps, at most about 80 MB.
CACHED_WORDS = 120_000
#: States that a worker adds to the compiled ones, some 60 MB.
MORE_STATES = 100_000
#: Longer words are not cached.
CACHED_CHARS = 40


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(codes: list[int]) -> str:
    """The inside of a character class."""
    out: list[list[int]] = []
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in out)


def char_classes(content: str) -> dict[str, str]:
    """L, N and S as the tokenizers library has them: its Unicode version decides, not that of Python. A code point after
    a letter or a number belongs to its class if the library does not split there; white space does not join a sign before it."""
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(content).pre_tokenizer.pre_tokenize_str
    codes = [c for c in range(0x80, 0x110000) if unicodedata.category(chr(c))[0] in "LN" or c < 0x34000 and unicodedata.category(chr(c)) == "Cn"]
    out = {"L": [*range(0x41, 0x5B), *range(0x61, 0x7B)], "N": [*range(0x30, 0x3A)], "S": [*range(0x09, 0x0E), 0x20]}
    for name, before in (("L", "a"), ("N", "1")):
        for i in range(0, len(codes), 1024):
            part = codes[i : i + 1024]
            begins = {x for _, (x, _) in split("".join(f"{before}{chr(c)}!" for c in part))}
            out[name] += [c for k, c in enumerate(part) if 3 * k + 1 not in begins]
    maybe = [c for c in range(0x80, 0x3001) if chr(c).isspace()]
    out["S"] += [c for c in maybe if len(split(f"!{chr(c)}")) == 2]
    return {k: _ranges(v) for k, v in out.items()}


def compile_merges(content: str) -> dict:
    """The tables of a vocabulary file's content: labels (bytes by id), gadgets (left, right and rank by id; rank by pair), specials."""
    spec = json.loads(content)
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    n = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    labels = [b""] * n
    for token, i in vocab.items():
        labels[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    for token, i in specials.items():
        labels[i] = token.encode()
    left, right, rank, pairs = [-1] * n, [-1] * n, [-1] * n, {}
    for r, merge in enumerate(spec["model"]["merges"]):
        u, v = merge.split(" ") if isinstance(merge, str) else merge
        a, b, t = vocab[u], vocab[v], vocab[u + v]
        pairs[a, b] = r
        if rank[t] < 0:
            left[t], right[t], rank[t] = a, b, r
    classes = char_classes(content)
    pattern = "".join(classes.get(c, c) for c in PATTERN)
    tables = {"labels": labels, "left": left, "right": right, "rank": rank, "pairs": pairs, "specials": specials, "pattern": pattern, "space": classes["S"]}
    tables["real"] = _real(tables)
    return tables | _spelled(labels, [i for i in vocab.values() if i not in specials.values() and tables["real"][i]]) | {"states": [(0,)], "ends": [-1], "table": {}} | _compiled(tables, vocab, specials)


def _open(tables: dict, a: int, b: int, before: int) -> bool:
    """Whether, after the gadgets of the merges up to ``before``, the state after token a has an arc b."""
    rank, pairs, left, right = tables["rank"], tables["pairs"], tables["left"], tables["right"]
    while True:
        if pairs.get((a, b), before) < before:
            return False
        if rank[a] < 0 and rank[b] < 0:
            return True
        if rank[a] > rank[b]:  # token a led where its right part led
            before, a = rank[a], right[a]
        else:  # arc b was added where its left part could be read; u, u is merged from the left, so not after a single u
            before, b = rank[b] + 1, left[b]


def _real(tables: dict) -> list[bool]:
    """The tokens with arcs: those whose own merge could be read when it came."""
    left, right, rank = tables["left"], tables["right"], tables["rank"]
    real = [True] * len(rank)
    for t in sorted((i for i, r in enumerate(rank) if r >= 0), key=rank.__getitem__):
        real[t] = real[left[t]] and real[right[t]] and _open(tables, left[t], right[t], rank[t])
    return real


def _spelled(labels: list[bytes], tokens: list[int]) -> dict:
    """The arcs spelled out: step, from place * 256 + byte to the place after it; and the token, if any, that ends at a place.
    The place before any byte is 0."""
    step, token = {}, [-1]
    for t in tokens:
        at = 0
        for byte in labels[t]:
            key = at << 8 | byte
            if key not in step:
                step[key] = len(token)
                token.append(-1)
            at = step[key]
        token[at] = t
    return {"step": step, "token": token}


def _compiled(tables: dict, vocab: dict, specials: dict) -> dict:
    """States, ends and table of the byte automaton, for all that the vocabulary's labels lead through."""
    own = {i for i in vocab.values() if i not in specials.values() and tables["real"][i]}
    spelled = _spelled(tables["labels"], sorted(own))
    a = Automaton(tables | spelled | {"states": [(0,)], "ends": [-1], "table": {}})
    for t in sorted(own):
        a.run(tables["labels"][t])
    return {"states": a.states, "ends": a.ends, "table": a.table}


class Automaton:
    """The compiled automaton. A state is a sorted tuple of (token before + 1) * 2^24 + place, an arc under way each."""

    def __init__(self, tables: dict):
        self.tables, self.labels, self.specials, self.real = tables, tables["labels"], tables["specials"], tables["real"]
        self.sizes = list(map(len, self.labels))
        self.step, self.token = tables["step"], tables["token"]
        self.states, self.ends, self.table = list(tables["states"]), list(tables["ends"]), dict(tables["table"])
        self.compiled = len(self.states)
        self.known = {x: i for i, x in enumerate(self.states)}
        self.arcs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.split, self.odd_space = re.compile(tables["pattern"]).findall, re.compile(rf" (?:[{tables['space']}]|$)").search
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def follows(self, a: int, b: int) -> bool:
        """Whether the state after token a (-1: at the beginning) has an arc b."""
        known = self.arcs.get((a, b))
        if known is None:
            if len(self.arcs) >= MORE_STATES:
                self.arcs.clear()
            known = self.arcs[a, b] = self.real[b] and (a < 0 or _open(self.tables, a, b, len(self.tables["pairs"]) + 1))
        return known

    def _next(self, state: int, byte: int) -> int:
        """A transition that is not in the table yet."""
        after, end, step, token = [], -1, self.step, self.token
        for arc in self.states[state]:
            place = step.get((arc & 0xFFFFFF) << 8 | byte)
            if place is not None:
                before = arc >> 24
                after.append(before << 24 | place)
                if token[place] >= 0 and self.follows(before - 1, token[place]):
                    end = token[place]
        after.append(end + 1 << 24)
        key = tuple(sorted(after))
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.states)
            self.states.append(key)
            self.ends.append(end)
        self.table[state << 8 | byte] = to
        return to

    def _forget(self, state: int) -> int:
        """Back to the compiled states and ``state``, which gets a new number."""
        n, held = self.compiled, (self.states[state], self.ends[state])
        for key in self.states[n:]:
            del self.known[key]
        del self.states[n:], self.ends[n:]
        self.table = {k: v for k, v in self.table.items() if v < n and k >> 8 < n}
        if state < n:
            return state
        self.known[held[0]] = n
        self.states.append(held[0])
        self.ends.append(held[1])
        return n

    def run(self, word: bytes) -> list[int]:
        """The label of the state after each byte: the token that ends there."""
        state, get, ends, out = 0, self.table.get, self.ends, []
        for byte in word:
            to = get(state << 8 | byte)
            if to is None:
                if len(self.states) >= self.compiled + MORE_STATES:
                    state = self._forget(state)
                    get = self.table.get
                to = self._next(state, byte)
            state = to
            out.append(ends[to])
        return out

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        ends, sizes, out = self.run(word), self.sizes, []
        at = len(word)
        while at:
            t = ends[at - 1]
            out.append(t)
            at -= sizes[t]
        out.reverse()
        return tuple(out)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        out: list[int] = []
        for word in self.split(piece):
            got = self.words.get(word)
            if got is None:
                got = self.encode_word(word.encode())
                if len(self.words) < CACHED_WORDS and len(word) <= CACHED_CHARS:
                    self.words[word] = got
            out.extend(got)
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        parts = self.special.split(text) if self.special and any(s in text for s in self.specials) else [text]
        pieces, extend = self.pieces, out.extend
        for part in parts:
            if part in self.specials:
                out.append(self.specials[part])
            elif self.odd_space(part):
                extend(self.encode_piece(part))
            else:  # a space before anything but white space begins a word, so what stands between spaces can be cached whole
                first, *rest = part.split(" ")
                extend(self.encode_piece(first))
                for piece in rest:
                    got = pieces.get(piece)
                    if got is None:
                        got = self.encode_piece(" " + piece)
                        if len(pieces) < CACHED_WORDS and len(piece) <= CACHED_CHARS:
                            pieces[piece] = got
                    extend(got)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


def _automaton(key: str, tables) -> Automaton:
    """A Python worker's automaton. It is kept from task to task, and for all queries on the same vocabulary: a worker never
    holds two, nor reads the broadcast tables again."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Automaton(pickle.loads(tables.value))
    return _KEPT[key]


_KEPT: dict[str, Automaton] = {}


def _shared(spark: SparkSession, path: str) -> Callable[[], Automaton]:
    """What gives each Python worker its automaton. The driver reads the file; one task compiles it, once for each session,
    and the driver keeps the tables pickled, some 8 MB."""
    if path not in _COMPILED:
        with open(path, encoding="utf-8") as f:
            content = f.read()

        def compiled(_):
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(compile_merges(content))], pa.binary())], ["tables"])

        _COMPILED[path] = bytes(spark.range(0, 1, 1, 1).mapInArrow(compiled, "tables binary").first().tables)
    packed = _COMPILED[path]
    key, tables = hashlib.sha256(packed).hexdigest(), spark.sparkContext.broadcast(packed)
    return lambda: _automaton(key, tables)


_COMPILED: dict[str, bytes] = {}


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the array of ids ``out``."""
    automaton = _shared(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        a = automaton()
        return texts.map(lambda t: a.encode(t or ""))

    return docs.withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the text ``out`` that the ids spell."""
    automaton = _shared(df.sparkSession, path)

    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        a = automaton()
        return rows.map(lambda r: a.decode([] if r is None else list(r)))

    return df.withColumn(out, texts(F.col(ids)))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row. Both ways in one step, so that ids never leave the worker,
    which holds one text at a time besides its Arrow batch."""
    automaton = _shared(docs.sparkSession, path)

    def make(batches):
        a, sha = automaton(), lambda b: hashlib.sha256(b).hexdigest()
        names = list(map(str, range(len(a.labels))))
        for b in batches:
            n, i, d = [], [], []
            for t in b.column(1):
                ids = a.encode(t.as_py() or "")
                n.append(len(ids))
                i.append(sha(",".join(map(names.__getitem__, ids)).encode()))
                d.append(sha(a.decode(ids).encode()))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    """The public vocabulary file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
