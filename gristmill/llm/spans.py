"""Offset-preserving SentencePiece encoding, and decoding.

Normalisation goes from left to right: at each place the longest prefix that the compiled character map holds
is replaced, else one code point stays as it is; every byte that comes out remembers the source bytes it came from.
The normalised text is split into pieces by byte-pair merges, the pair with the best score first and the leftmost of those, and
as pieces tile it, running sums of piece lengths and the recorded
alignment give each piece's span of bytes in the original text. A byte piece is one byte of its character: all but
the last byte of a character project to an empty span at the character's start, the last to the whole character.
Decoding joins what the pieces stand for. The model file gives the pieces, their scores and the map; no library encodes or decodes.

Where blanks only begin pieces, no merge crosses from a letter to a blank, so a text is cut there and each word is
merged once and remembered (a bounded number of words). Words that a run of texts holds for the first time are merged together, one pair of each in a round.

Defined cases: null is empty; an empty text is the begin and end ids alone; repeated rows and null doc_ids
are encoded like any other; columns other than doc_id and text are never read. In a model without byte pieces a run of unknown characters is one
unknown id with the span of the run. Ids of byte pieces that are no UTF-8 decode to U+FFFD, byte by byte. A model that is not of the byte-pair
kind or has pieces defined by its user or unused ones raises ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import ODD

MARK = "▁".encode()


class CharacterMap:
    """The compiled map: a little-endian size, a double-array trie of 32-bit units, then NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest key that starts at ``at``."""
        units, found = self.units, None
        unit = units[0]
        node = unit >> 10 << ((unit & 0x200) >> 6)
        for k in range(at, len(data)):
            node ^= data[k]
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= unit >> 10 << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.strings[start : self.strings.index(0, start)]
        return found


class Normalizer:
    """Normalised bytes of a text with, for each, the source range it came from."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def steps(self, data: bytes) -> list[tuple[bytes, int, int]]:
        """(bytes out, source start, source end) from left to right."""
        out, at = [], 0
        while at < len(data):
            hit = self.map.longest(data, at) if self.map else None
            if hit is None:
                lead = data[at]
                n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                hit = n, data[at : at + n]
            out.append((hit[1], at, at + hit[0]))
            at += hit[0]
        return out

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        if self.map is None and not self.squeeze:
            return self._plain(data)
        steps = self.steps(data)
        if self.squeeze:
            kept, blank = [], True
            for text, lo, hi in steps:
                part = b"".join(bytes([c]) for i, c in enumerate(text) if c != 32 or not (blank if i == 0 else text[i - 1] == 32))
                if part:
                    blank = part.endswith(b" ")
                    kept.append((part, lo, hi))
            while kept and kept[-1][0].endswith(b" "):
                text, lo, hi = kept.pop()
                if text.rstrip(b" "):
                    kept.append((text.rstrip(b" "), lo, hi))
            steps = kept
        if self.prefix and steps:
            steps.insert(0, (b" ", steps[0][1], steps[0][1]))
        if self.escape:
            steps = [(t.replace(b" ", MARK), lo, hi) for t, lo, hi in steps]
        sizes = [len(t) for t, _, _ in steps]
        return b"".join(t for t, _, _ in steps), np.repeat([lo for _, lo, _ in steps], sizes).astype(np.int64), np.repeat([hi for _, _, hi in steps], sizes).astype(np.int64)

    def _plain(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The same for an empty map, where every code point stays: no loop over characters."""
        if not data:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        raw = np.frombuffer(data, np.uint8)
        first = np.flatnonzero((raw & 0xC0) != 0x80)
        size = np.diff(np.append(first, len(raw)))
        lo, hi = np.repeat(first, size), np.repeat(first + size, size)
        if self.escape:
            wide = np.where(raw == 32, 3, 1)
            lo, hi = np.repeat(lo, wide), np.repeat(hi, wide)
            data = data.replace(b" ", MARK)
        if self.prefix:
            mark = MARK if self.escape else b" "
            data = mark + data
            lo, hi = (np.concatenate([np.zeros(len(mark), np.int64), x]) for x in (lo, hi))
        return data, lo, hi


class Pairs:
    """What two symbols merge to: a table of hashed pairs with linear probing."""

    def __init__(self, left: list[int], right: list[int], both: list[int]):
        keys = self.key(np.array(left, np.int64), np.array(right, np.int64))
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.both = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slots, both = self.slot(keys), np.array(both, np.int32)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            here = self.keys[slots] == keys
            self.both[slots[here]] = both[here]
            keys, both, slots = keys[~here], both[~here], slots[~here] + 1 & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(ODD) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged symbol of each pair, -1 where there is none."""
        keys = self.key(left, right)
        slots = self.slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.both[slots], np.int32(-1))
        rest = np.flatnonzero((held != keys) & (held >= 0))
        while len(rest):
            slots[rest] = slots[rest] + 1 & self.mask
            held = self.keys[slots[rest]]
            hit = held == keys[rest]
            out[rest[hit]] = self.both[slots[rest[hit]]]
            rest = rest[~hit & (held >= 0)]
        return out


class Merger(dict):
    """Packed unsigned 32-bit ids of a stretch of normalised text, remembered for short stretches: at most ``most`` and those learnt last."""

    def __init__(self, ids: dict[str, int], scores: dict[str, float], unknown: int, raw: list[int] | None, most: int = 400_000, short: int = 40, part: int = 1 << 16):
        self.ids, self.unknown, self.raw, self.most, self.short, self.part = ids, unknown, raw, most, short, part
        place = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {text: place[score] for text, score in scores.items()}
        symbols = {text: k for k, text in enumerate([*ids, *sorted({c for text in ids for c in text} - ids.keys())])}
        splits = [(symbols[text[:k]], symbols[text[k:]], symbols[text]) for text in self.ranks for k in range(1, len(text)) if text[:k] in symbols and text[k:] in symbols]
        self.pairs = Pairs(*zip(*splits)) if splits else Pairs([], [], [])
        self.other = len(symbols)  # any character that no piece holds, and what lies beyond a stretch
        self.id_of = np.array([ids.get(text, -1) for text in symbols] + [-1], np.int64)
        self.symbol_of = np.full(0x110000, self.other, np.int32)
        for text, k in symbols.items():
            if len(text) == 1:
                self.symbol_of[ord(text)] = k
        self.last = len(place) * 64
        self.rank_of = np.array([place[scores[text]] * 64 if text in scores else self.last for text in symbols] + [self.last] * 2, np.int32)

    def __missing__(self, text: str) -> bytes:
        if 0 < len(text) <= self.short:
            self.learn([text])
            return self[text]
        ids = self.named(self.merged_long(list(text)))
        return struct.pack(f"<{len(ids)}I", *ids)

    def joined(self, stretches: list[str]) -> bytes:
        """All ids of a text of any length, learnt in parts of ``part`` stretches."""
        out = []
        for at in range(0, len(stretches), self.part):
            part = stretches[at : at + self.part]
            self.learn(part)
            out.append(b"".join(map(self.__getitem__, part)))
        return b"".join(out)

    def learn(self, stretches: Iterable[str]) -> None:
        """Remember the short ones of ``stretches``: all that are new are merged together."""
        if len(self) >= self.most:
            self.clear()
        fresh = sorted((x for x in set(stretches).difference(self) if 0 < len(x) <= self.short), key=len)
        if not fresh:
            return
        whole = "".join(fresh)
        data = np.frombuffer(whole.encode(), np.uint8)
        sizes = np.array([len(x) for x in fresh])
        starts = np.cumsum(sizes) - sizes
        symbols = self.symbol_of[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
        live = np.ones(len(symbols), bool)
        at = 0
        while at < len(fresh):
            to = int(np.searchsorted(sizes, sizes[at] + sizes[at] // 4, "right"))
            self._merge(symbols, live, starts[at:to], sizes[at:to])
            at = to
        place = np.flatnonzero(live)
        ids = self.id_of[symbols[place]]
        first = np.flatnonzero((data & 0xC0) != 0x80)
        n = np.ones(len(ids), np.int64)
        if self.raw is not None:
            n = np.where(ids < 0, np.diff(np.append(first, len(data)))[place], n)
        ends = np.cumsum(n)
        out = np.repeat(ids, n)
        lack = np.flatnonzero(out < 0)
        if self.raw is None:
            out[lack] = self.unknown
        elif len(lack):
            out[lack] = np.array(self.raw)[data[np.repeat(first[place] - (ends - n), n)[lack] + lack]]
        packed = out.astype("<u4").tobytes()
        cuts = (4 * np.append(0, ends)[np.searchsorted(place, np.append(starts, len(live)))]).tolist()
        self.update((x, packed[lo:hi]) for x, lo, hi in zip(fresh, cuts, cuts[1:]))

    def _merge(self, symbols: np.ndarray, live: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Merge the stretches that start at ``starts``: in each round the best pair of every one, the leftmost of those.

        A column is a stretch, rows 1 to n are its characters; a merged symbol stands where its first character did. ``keys`` holds a pair's rank times 64
        and its row.
        """
        n, most = len(starts), int(sizes.max())
        rows = np.arange(most)[:, None]
        inside = rows < sizes
        source = (starts + rows)[inside]
        table = np.full((most + 2, n), self.other, np.int32)
        table[1:-1][inside] = symbols[source]
        both = np.full((most + 2, n), -1, np.int32)
        both[1:-1] = self.pairs(table[1:-1].ravel(), table[2:].ravel()).reshape(most, n)
        row = np.arange(most + 2, dtype=np.int32)[:, None]
        keys = self.rank_of[both] + row
        after, before = np.repeat(row + 1, n, 1).ravel(), np.repeat(row - 1, n, 1).ravel()
        stays = np.ones((most + 2, n), bool).ravel()
        table, both, flat = table.ravel(), both.ravel(), keys.ravel()
        active = np.arange(n)
        while len(active):
            best = np.take(keys, active, axis=1).min(axis=0)
            going = best < self.last
            active, spot = active[going], best[going] & 63
            here = spot * n + active
            gone = after[here] * n + active
            table[here] = both[here]
            stays[gone] = False
            right = after[gone]
            left = before[here]
            after[here] = right
            flat[gone] = self.last
            ahead, behind = right * n + active, left * n + active
            before[ahead] = spot
            made = self.pairs(np.concatenate([table[here], table[behind]]), np.concatenate([table[ahead], table[here]]))
            pair = np.concatenate([here, behind])
            both[pair] = made
            flat[pair] = self.rank_of[made] + np.concatenate([spot, left])
        symbols[source] = table.reshape(most + 2, n)[1:-1][inside]
        live[source] = stays.reshape(most + 2, n)[1:-1][inside]

    def merged_long(self, parts: list[str]) -> list[str]:
        """The same with a queue of pairs, for stretches of any length."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[int, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right < len(parts) and (rank := self.ranks.get(both := parts[left] + parts[right])) is not None:
                heapq.heappush(queue, (rank, left, right, both))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while queue:
            _, left, right, both = heapq.heappop(queue)
            if parts[left] and parts[right] and len(parts[left]) + len(parts[right]) == len(both):
                parts[left], parts[right] = both, ""
                after[left] = after[right]
                if after[left] < len(parts):
                    before[after[left]] = left
                offer(before[left], left)
                offer(left, after[left])
        return [x for x in parts if x]

    def named(self, parts: list[str]) -> list[int]:
        try:
            return [self.ids[x] for x in parts]
        except KeyError:
            out: list[int] = []
            for part in parts:
                if (known := self.ids.get(part)) is not None:
                    out.append(known)
                elif self.raw is None:
                    out.append(self.unknown)
                else:
                    out.extend(self.raw[x] for x in part.encode())
            return out


class SpanEncoder:
    """ids, original byte spans and decoded texts under one SentencePiece model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as model:
            proto.ParseFromString(model.read())
        kinds, pieces = proto.SentencePiece, proto.pieces
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in pieces):
            raise ValueError("only byte-pair models without user-defined and unused pieces are read")
        self.normalize = Normalizer(proto.normalizer_spec)
        of = {p.piece: k for k, p in enumerate(pieces)}
        self.unknown, self.begin, self.end = next(k for k, p in enumerate(pieces) if p.type == kinds.UNKNOWN), of[proto.trainer_spec.bos_piece], of[proto.trainer_spec.eos_piece]
        self.raw = [of[f"<0x{x:02X}>"] for x in range(256)] if proto.trainer_spec.byte_fallback else None
        normal = {p.piece: k for k, p in enumerate(pieces) if p.type == kinds.NORMAL}
        self.merged = Merger(normal, {t: pieces[k].score for t, k in normal.items()}, self.unknown, self.raw)
        mark = MARK.decode()
        self.stretch = None if any(mark in t.lstrip(mark) for t in normal) else re.compile(f"{mark}+[^{mark}]*|[^{mark}]+")

        self.byte = np.array([p.type == kinds.BYTE for p in pieces])
        self.control = [p.type == kinds.CONTROL for p in pieces]
        self.width = np.array([0 if p.type == kinds.CONTROL else 1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in pieces])
        self.marked = [p.type == kinds.NORMAL and p.piece.startswith(mark) for p in pieces]
        value = {kinds.CONTROL: lambda p: b"", kinds.BYTE: lambda p: bytes([int(p.piece[3:-1], 16)]), kinds.UNKNOWN: lambda p: proto.trainer_spec.unk_surface.encode()}
        self.values = [value.get(p.type, lambda p: p.piece.replace(mark, " ").encode())(p) for p in pieces]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end): each id with its span in the bytes of ``text``; begin and end ids stand at the two ends."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``encode`` of each text; new stretches of runs of at most ``most`` characters, or of one text's parts, are merged together."""
        run, size = [], 0
        for text in texts:
            if run and size + len(text) > most:
                yield from self._encode_run(run)
                run, size = [], 0
            run.append(text)
            size += len(text)
        yield from self._encode_run(run)

    def _encode_run(self, run: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cut = []
        for text in run:
            data = text.encode()
            normal, lo, hi = self.normalize(data)
            whole = normal.decode()
            cut.append((normal, np.append(lo, len(data)), np.append(hi, len(data)), self.stretch.findall(whole) if self.stretch else [whole]))
        if len(run) > 1:
            self.merged.learn(chain.from_iterable(stretches for *_, stretches in cut))
        for normal, lo, hi, stretches in cut:
            ids = np.frombuffer(b"".join(map(self.merged.__getitem__, stretches)) if len(run) > 1 else self.merged.joined(stretches), "<u4")
            width = self.width[ids]
            if self.raw is None and (ids == self.unknown).any():
                ids, width = self._unknown_runs(normal, ids, width)
            ids = np.concatenate([[self.begin], ids, [self.end]]).astype(np.uint32)
            yield ids, *self._project(ids, np.concatenate([[0], width, [0]]), lo, hi)

    def _unknown_runs(self, normal: bytes, ids: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width, at = width.copy(), 0
        for k, i in enumerate(ids.tolist()):
            if i == self.unknown:
                lead = normal[at]
                width[k] = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            at += int(width[k])
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
        return ids[fresh], np.add.reduceat(width, np.flatnonzero(fresh))

    def _project(self, ids: np.ndarray, width: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum(width)
        begin = end - width
        first, last = lo[begin], np.where(width > 0, hi[np.maximum(end, 1) - 1], lo[begin])
        inner = self.byte[ids] & (width > 0)
        inner[:-1] &= self.byte[ids][1:]
        at = np.flatnonzero(inner)
        at = at[lo[end[at]] == lo[begin[at]]]
        last[at] = first[at]
        return first, last

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.tolist()
        parts = list(map(self.values.__getitem__, ids))
        if self.normalize.prefix or self.normalize.squeeze:
            for k, i in enumerate(ids):
                if not self.control[i]:
                    if self.marked[i]:
                        parts[k] = parts[k][1:]
                        if self.normalize.squeeze and not parts[k]:
                            continue
                    break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self._mended(ids, parts)

    def _mended(self, ids: list[int], parts: list[bytes]) -> str:
        out, run = [], b""
        for i, part in zip([*ids, None], [*parts, b""]):
            if i is not None and self.byte[i]:
                run += part
                continue
            while run:
                n = next((n for n in (1, 2, 3, 4) if _is_character(run[:n])), 0)
                out.append(run[:n].decode() if n else "\ufffd")
                run = run[n or 1 :]
            out.append(part.decode())
        return "".join(out)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


SCHEMA = "doc_id long, n_tokens long, ids array<int>, begins array<long>, ends array<long>, decoded string"


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids, begins, ends, decoded of every document."""

    def run(batches):
        encoder = SpanEncoder(model)
        for batch in batches:
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc, (ids, begins, ends) in zip(batch.column(0).to_pylist(), encoder.encode_all(texts)):
                one = [pa.array([doc], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([ids.astype(np.int32)]), pa.array([begins]), pa.array([ends]), pa.array([encoder.decode(ids)], pa.string())]
                yield pa.RecordBatch.from_arrays(one, ["doc_id", "n_tokens", "ids", "begins", "ends", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256: what encode_documents gives, as digests."""

    def run(batches):
        encoder = SpanEncoder(model)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            rows = []
            texts = (text.as_py() or "" for text in batch.column(1))
            for doc, (ids, begins, ends) in zip(batch.column(0).to_pylist(), encoder.encode_all(texts)):
                spans = np.stack([begins, ends], 1).astype("<i8").tobytes()
                rows.append((doc, len(ids), *(hashlib.sha256(x).hexdigest() for x in (ids.astype("<u4").tobytes(), encoder.decode(ids).encode(), spans))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
