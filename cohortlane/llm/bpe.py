"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

The merges of a rank file make a transducer. It reads bytes and keeps every way in which the
bytes seen last can still end in a token: a hypothesis is the last token before some earlier
place and the node of the token trie that the bytes since then have reached. A prefix of a piece
has exactly one tokenization, and a token may follow another only if merging the bytes of both
gives the two back, so a step extends each hypothesis by a byte and finds the one token that ends
here. Hypotheses die as soon as no token goes on with their bytes. The set of hypotheses is the
state; states and moves are made when first met and kept up to a bound. All hypotheses start
within one token length of the input's place, so tokens before the place that all of them trace
back to are final and are emitted.

Decoding runs tokens through a state machine over UTF-8 bytes and gives out whole characters only.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from cohortlane.llm.frames import per_text

#: The characters with the Unicode property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
CHUNK = regex.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space before a space: there the text is cut by CHUNK, elsewhere at every space.
ASCII_RUNS = tuple(f"{c} " for c in WHITE if c.isascii())
WIDE_RUN = re.compile("[" + "".join(c for c in WHITE if not c.isascii()) + "] ")
MAX_STATES = 200_000
MAX_CHUNKS = 250_000
ROOT, NEVER = 0, 1 << 60
NODE_BITS = 24
NODE_MASK = (1 << NODE_BITS) - 1
#: Bytes of one piece after which shared tokens are emitted; more than any token has.
LONG = 4096


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Tokens of one piece of text, byte by byte."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES):
        self.ranks, self.max_states = ranks, max_states
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.lengths = {rank: len(token) for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends, self.depths = [-1], [0]
        for token, rank in ranks.items():
            node = ROOT
            for depth, byte in enumerate(token, 1):
                node = self.children[node].setdefault(byte, len(self.children))
                if node == len(self.children):
                    self.children.append({})
                    self.ends.append(-1)
                    self.depths.append(depth)
            self.ends[node] = rank
        self._edges: dict[int, tuple[list, list] | None] = {}
        self._follows: dict[int, bool] = {}
        self._reset((0,))

    def _reset(self, state: tuple) -> int:
        """Forget all states but the first and ``state``; returns the number of ``state``."""
        self.states = [(0,)]
        self.known = {(0,): 0}
        self.moves: dict[int, tuple[int, int]] = {}
        if state not in self.known:
            self.known[state] = 1
            self.states.append(state)
        return self.known[state]

    def merged(self, piece: bytes, below: int = NEVER) -> list[int]:
        """The tokens by the merges themselves, of ranks under ``below``: lowest rank first, leftmost among equals."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, best = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[part] for part in parts]

    def _edge(self, token: int) -> tuple[list, list] | None:
        """What stands at the token's left and right end while it is merged, and until which rank.

        None if the merges never make this token.
        """
        if token not in self._edges:
            whole = self.tokens[token]
            self._edges[token] = None
            if len(whole) == 1:
                self._edges[token] = [(whole, NEVER)], [(whole, NEVER)]
            elif len(last := self.merged(whole, token)) == 2:
                left, right = self._edge(last[0]), self._edge(last[1])
                if left and right:
                    self._edges[token] = tuple([*side[:-1], (side[-1][0], token), (whole, NEVER)] for side in (left[0], right[1]))
        return self._edges[token]

    def _apart(self, last: int, token: int) -> bool:
        """Whether the merges keep ``last`` and ``token`` apart.

        What meets at the border changes as the merges on both sides go on. The two stay apart
        if no pair that meets there is merged before one of its halves is.
        """
        before, after = self._edge(last), self._edge(token)
        if before is None or after is None:
            return False
        before, after = before[1], after[0]
        ranks, i, j = self.ranks, 0, 0
        while True:
            u, u_until = before[i]
            v, v_until = after[j]
            rank = ranks.get(u + v)
            if rank is not None and rank < u_until and rank <= v_until:
                return False
            if u_until <= v_until:
                if u_until == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` can stand after ``last`` (-1: at the start)."""
        if last < 0:
            return self._edge(token) is not None
        key = last << 32 | token
        found = self._follows.get(key)
        if found is None:
            if len(self._follows) > 2 * self.max_states:
                self._follows.clear()
            found = self._follows[key] = self._apart(last, token)
        return found

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        children, ends = self.children, self.ends
        after, ended = [], -1
        for path in self.states[state]:
            last, node = path >> NODE_BITS, children[path & NODE_MASK].get(byte)
            if node is None:
                continue
            if children[node]:
                after.append(last << NODE_BITS | node)
            if ended < 0 and (token := ends[node]) >= 0 and self.follows(last - 1, token):
                ended = token
        after.append(ended + 1 << NODE_BITS)
        after = tuple(after)
        number = self.known.get(after)
        if number is None:
            number = self.known[after] = len(self.states)
            self.states.append(after)
        self.moves[state << 8 | byte] = move = number, ended
        return move

    def _last(self, state: int, byte: int) -> int:
        """The token that ends with the piece; the state after it is not needed and not made."""
        move = self.moves.get(state << 8 | byte)
        if move is not None:
            return move[1]
        for path in self.states[state]:
            node = self.children[path & NODE_MASK].get(byte)
            if node is not None and (token := self.ends[node]) >= 0 and self.follows((path >> NODE_BITS) - 1, token):
                return token
        raise ValueError("a byte is no token of these ranks")

    def _traced(self, ended: list[int], place: int) -> list[int]:
        """The tokens up to ``place``, from the token that ends at each place."""
        found, lengths = [], self.lengths
        while place:
            token = ended[place - 1]
            found.append(token)
            place -= lengths[token]
        found.reverse()
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        emitted: list[int] = []
        state, ended = 0, []
        most = len(piece) - 1
        for begin in range(0, most, LONG):
            if begin:
                ended = self._emit(state, ended, emitted)
            state = self._read(state, piece[begin : min(begin + LONG, most)], ended)
        ended.append(self._last(state, piece[most]))
        return (*emitted, *self._traced(ended, len(ended)))

    def _read(self, state: int, portion: bytes, ended: list[int]) -> int:
        """Read on from ``state``, add the token that ends at each place to ``ended``, return the state."""
        get, add = self.moves.get, ended.append
        for byte in portion:
            move = get(state << 8 | byte)
            if move is None:
                if len(self.states) > self.max_states:
                    state = self._reset(self.states[state])
                    get = self.moves.get
                move = self._step(state, byte)
            state, token = move
            add(token)
        return state

    def _emit(self, state: int, ended: list[int], emitted: list[int]) -> list[int]:
        """Move the tokens that all hypotheses share from ``ended`` to ``emitted``."""
        paths = [self._traced(ended, len(ended) - self.depths[p & NODE_MASK]) for p in self.states[state]]
        shared = paths[0]
        for path in paths[1:]:
            n = next((i for i, (a, b) in enumerate(zip(shared, path)) if a != b), min(len(shared), len(path)))
            shared = shared[:n]
        emitted += shared
        return ended[sum(self.lengths[t] for t in shared) :]


class Chunks(dict):
    """Tokens by chunk, packed as unsigned 32-bit numbers; a chunk not held goes through the transducer.

    A chunk of several matches of the pattern is put together from theirs. When full, the chunks
    held become the generation before, from which those met again are taken.
    """

    def __init__(self, transducer: Transducer, pattern: str, most: int):
        super().__init__()
        self.transducer, self.find, self.most = transducer, regex.compile(pattern).findall, most
        self.before: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.before.get(chunk)
        if found is None:
            if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
                pieces = [chunk]  # one match of the pattern
            else:
                pieces = self.find(chunk)
            if len(pieces) > 1:
                found = b"".join(map(self.__getitem__, pieces))
            else:
                found = array("I", self.transducer.encode(chunk.encode("utf-8"))).tobytes()
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[chunk] = found
        return found


class Encoder:
    """Token ids of whole texts.

    Texts are cut where white space follows other characters. No match of the pattern spans such
    a place, so equal chunks have equal tokens wherever they stand, and each distinct chunk goes
    through the transducer once as long as it is kept.
    """

    def __init__(self, path: str, pattern: str, max_chunks: int = MAX_CHUNKS):
        self.transducer = Transducer(load_ranks(path))
        self.chunks = Chunks(self.transducer, pattern, max_chunks)

    def packed(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit numbers, one after the other."""
        if not text:
            return b""
        if any(pair in text for pair in ASCII_RUNS) or not text.isascii() and WIDE_RUN.search(text):
            words = CHUNK.findall(text)
        else:
            first, *rest = text.split(" ")
            words = [first, *[" " + word for word in rest]] if first else [" " + word for word in rest]
        return b"".join(map(self.chunks.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.uint32).tolist()


def utf8_machine() -> list[list[int]]:
    """Moves of the state machine over UTF-8: ``table[state][byte]`` is the next state.

    State 0 stands between characters, 1 is an error. The other states are what may follow: the
    number of bytes missing and the range of the next one, which rules out overlong forms,
    surrogates and values beyond the last code point.
    """
    states: dict[tuple, int] = {(): 0, ("error",): 1}
    table: list[list[int]] = [[1] * 256, [1] * 256]

    def state(missing: tuple) -> int:
        if missing not in states:
            states[missing] = len(table)
            table.append([1] * 256)
            low, high = missing[0]
            after = state(missing[1:])
            for byte in range(low, high + 1):
                table[states[missing]][byte] = after
        return states[missing]

    tail = (0x80, 0xBF)
    for byte in range(0x80):
        table[0][byte] = 0
    for byte in range(0xC2, 0xE0):
        table[0][byte] = state((tail,))
    for byte in range(0xE0, 0xF0):
        first = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F)}.get(byte, tail)
        table[0][byte] = state((first, tail))
    for byte in range(0xF0, 0xF5):
        first = {0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, tail)
        table[0][byte] = state((first, tail, tail))
    return table


class Decoder:
    """Bytes and text of token ids, fed in any portions.

    For every token the moves of the UTF-8 machine over its bytes are composed once, so feeding a
    token is one lookup. ``feed`` returns the characters that are complete; the bytes of a
    character cut by a token boundary wait for the next token.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.table = tokens, utf8_machine()
        self.spans: dict[tuple[int, int], tuple[int, int]] = {}
        #: Tokens made of whole characters: they lead from between characters to between characters.
        self.whole = np.zeros(max(tokens, default=0) + 1, bool)
        for token in tokens:
            self.whole[token] = self._span(0, token)[0] == 0
        #: Ids as people write them, made once.
        self.decimal = {token: str(token) for token in tokens}
        self.reset()

    def reset(self) -> None:
        self.state, self.waiting = 0, b""

    def _span(self, state: int, token: int) -> tuple[int, int]:
        """State after the token, and how many of its last bytes belong to an open character (-1: all)."""
        open_from, before = -1, state
        for i, byte in enumerate(self.tokens[token]):
            if before == 0:
                open_from = i
            before = self.table[before][byte]
            if before == 0:
                open_from = len(self.tokens[token])
        self.spans[state, token] = before, -1 if open_from < 0 else len(self.tokens[token]) - open_from
        return self.spans[state, token]

    def feed(self, ids: list[int]) -> str:
        """The characters that these ids complete. Runs of whole characters are joined at once."""
        out, tokens, done = [], self.tokens, 0
        cut = np.flatnonzero(~self.whole[np.asarray(ids, np.int64)]).tolist()
        for at in [*cut, len(ids)]:
            while done < at and self.state:  # not between characters: token by token
                self._token(ids[done], out)
                done += 1
            if done < at:
                out += map(tokens.__getitem__, ids[done:at])
                done = at
            if done == at < len(ids):
                self._token(ids[at], out)
                done += 1
        return b"".join(out).decode("utf-8")

    def _token(self, token: int, out: list[bytes]) -> None:
        self.state, tail = self.spans.get((self.state, token)) or self._span(self.state, token)
        if self.state == 1:
            raise ValueError("the ids do not decode to UTF-8")
        piece = self.tokens[token]
        if tail < 0:
            self.waiting += piece
        else:
            out.append(self.waiting + piece[: len(piece) - tail])
            self.waiting = piece[len(piece) - tail :]

    def finish(self) -> None:
        if self.state:
            raise ValueError("the ids end inside a character")

    def decode_bytes(self, ids: list[int]) -> bytes:
        """All bytes, valid UTF-8 or not."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per Python worker, used by all its tasks.

    Its tables are large and free of cycles, so the collector of cycles looks at them less often.
    """
    gc.set_threshold(200_000, 20, 100)
    return Encoder(path, pattern)


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder({rank: token for token, rank in load_ranks(path).items()})


def bpe_encode(df: DataFrame, path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``ids``, the token ids of the text; null and empty texts have none."""
    add = StructType([StructField("ids", ArrayType(IntegerType(), False))])

    def factory():
        encode = encoder(path, pattern).encode
        return lambda texts: {"ids": [encode(t) for t in texts]}

    return per_text(df, keep, text, add, factory)


def bpe_decode(df: DataFrame, path: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """``keep`` and ``bytes``, ``text`` (null if the ids do not decode to UTF-8) of an array of ids; null has no bytes."""
    import pyarrow as pa

    plain = df.select(*[f"`{k}`" for k in keep], df[ids].alias("__ids"))
    add = [StructField("bytes", BinaryType()), StructField("text", StringType())]
    schema = StructType([*[plain.schema[k] for k in keep], *add])

    def run(batches):
        machine = decoder(path)
        for batch in batches:
            raw, texts = [], []
            for row in batch.column("__ids").to_pylist():
                machine.reset()
                raw.append(machine.decode_bytes(row or []))
                try:
                    text = machine.feed(row or [])
                    machine.finish()
                    texts.append(text)
                except ValueError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.array(raw, pa.binary()), pa.array(texts, pa.string())], names=[*keep, "bytes", "text"]
            )

    return plain.mapInArrow(run, schema)


def bpe_round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids in portions, and return digests of both.

    Per row: ``key``, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by one space,
    ``decoded_sha256`` of the decoded bytes, ``same`` whether they are the text's bytes. Null and
    empty texts have no tokens. Rows are independent: equal texts and equal keys stay rows of
    their own, an empty table gives an empty result, other columns are not read.
    """
    add = StructType(
        [
            StructField("n_tokens", LongType()),
            StructField("ids_sha256", StringType()),
            StructField("decoded_sha256", StringType()),
            StructField("same", BooleanType()),
        ]
    )
    portion = 4096

    def factory():
        encode, machine = encoder(path, pattern).encode, decoder(path)
        decimal = machine.decimal.__getitem__

        def compute(texts: list) -> dict:
            found: dict[str, list] = {name: [] for name in add.names}
            for value in texts:
                ids = encode(value)
                machine.reset()
                back = hashlib.sha256()
                for i in range(0, len(ids), portion):
                    back.update(machine.feed(ids[i : i + portion]).encode("utf-8"))
                machine.finish()
                found["n_tokens"].append(len(ids))
                found["ids_sha256"].append(hashlib.sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                found["decoded_sha256"].append(back.hexdigest())
                found["same"].append(back.digest() == hashlib.sha256((value or "").encode("utf-8")).digest())
            return found

        return compute

    return per_text(df, [key], text, add, factory)
