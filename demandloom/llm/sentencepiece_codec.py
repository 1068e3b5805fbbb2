"""SentencePiece encoding and decoding that keeps byte offsets.

A text is normalised by longest-prefix matches in the model's compiled character map (a double-array
trie), recording for every normalised character the byte of the original it came from.  The normalised
text is encoded by the model's merges (byte pieces for characters it lacks), and every piece is
projected to the original bytes through that record.

Encoding is made local without changing its result: no piece spans certain places (before a space mark
that follows something else, around a character that is part of no longer piece), so the text is cut
there and every distinct chunk is encoded once per task while it is remembered.  Two generations of chunks are
remembered: a full one becomes the older one, from which what is used again is taken over, so frequent
chunks are never encoded anew.  Long chunks are not remembered.

The new chunks of a slice of texts are merged together, one merge of each per turn, as rows of symbol numbers.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.batches import text_slices

MARK = "▁"
REPLACEMENT = "�".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
CACHED_CHUNKS = 100_000
LONG_CHUNK = 64
# chunks merged together, in rows of 8, 16, .. characters
TOGETHER = 4096
NO_PAIR = 1 << 30


class CharMap:
    """The compiled character map: a double-array trie whose values point to replacement strings."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = array("I", blob[4 : 4 + size])
        self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that ``data`` has at ``at`` and its replacement."""
        if not self.units:
            return None
        units, node, found = self.units, 0, None
        node ^= self._child(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[end]:
                break
            node ^= self._child(unit)
            if unit >> 8 & 1:
                found = (end + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        stop = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : stop]

    @staticmethod
    def _child(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(model)
        trainer, self.spec = proto.trainer_spec, proto.normalizer_spec
        kinds = [p.type for p in proto.pieces]
        if trainer.model_type != BPE or trainer.treat_whitespace_as_suffix or USER in kinds or UNUSED in kinds:
            raise ValueError("only merge models with marks in front and without user-defined pieces are supported")
        self.charmap = CharMap(self.spec.precompiled_charsmap)
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.fallback = trainer.byte_fallback
        self.surface = [
            b"" if p.type == CONTROL else trainer.unk_surface.encode() if p.type == UNKNOWN else p.piece.encode()
            for p in proto.pieces
        ]
        self.shown = [s.replace(MARK.encode(), b" ") for s in self.surface]
        self.chunks = re.compile(self._chunk_pattern(), re.DOTALL)
        self._number_symbols()
        self.clear()

    def _number_symbols(self) -> None:
        """Numbers of pieces and their characters, and of all pairs that make a piece: the place of its score, and it."""
        # a model's own size bounds these tables
        symbols = dict.fromkeys(self.ids)
        symbols |= dict.fromkeys(c for p in self.ids for c in p)
        number = {s: i for i, s in enumerate(symbols)}
        self.piece_of = np.array([self.ids.get(s, -1) for s in symbols], np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for s, i in number.items():
            if len(s) == 1:
                self.symbol_of[ord(s)] = i
        place = {s: i for i, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        pairs = {}
        for piece, score in self.score.items():
            for cut in range(1, len(piece)):
                left, right = number.get(piece[:cut]), number.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = (place[score], number[piece])
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_place = np.array([pairs[k][0] for k in sorted(pairs)] + [NO_PAIR], np.int32)
        self.pair_made = np.array([pairs[k][1] for k in sorted(pairs)] + [-1], np.int32)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of pairs of symbols; the last one for those that make no piece."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        known = (at < len(self.pair_keys)) & (left >= 0) & (right >= 0)
        known &= self.pair_keys[np.minimum(at, max(0, len(self.pair_keys) - 1))] == keys if len(self.pair_keys) else False
        return np.where(known, at, len(self.pair_keys))

    def _chunk_pattern(self) -> str:
        joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        inside = any(pair[1] == MARK and pair[0] != MARK for pair in joined)
        if inside:
            return ".+"
        if any("\n" in pair for pair in joined):
            return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        return f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+"

    def clear(self) -> None:
        """Forget cached chunks."""
        self._new_generation()
        self._new_generation()

    def _new_generation(self) -> None:
        """Forget the older generation; the present one takes its place."""
        self.older = (self.cache, self.flat_ids, self.flat_chars, self.begin, self.count) if hasattr(self, "cache") else None
        self.cache: dict[str, int] = {}
        # of all cached chunks one after another: piece ids, and the characters each piece takes
        self.flat_ids, self.flat_chars = array("i"), array("i")
        self.begin, self.count = array("q"), array("q")

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text and, for each of its character boundaries, the original byte."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.charmap.units and not self.spec.remove_extra_whitespaces and self.spec.escape_whitespaces:
            return self._normalise_plain(text)
        return self._normalise_mapped(text.encode())

    def _normalise_plain(self, text: str) -> tuple[str, np.ndarray]:
        code = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        width = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        prefix = int(self.spec.add_dummy_prefix)
        ends = np.zeros(len(code) + 1 + prefix, np.int64)
        np.cumsum(width, out=ends[1 + prefix :])
        return MARK * prefix + text.replace(" ", MARK), ends

    def _normalise_mapped(self, data: bytes) -> tuple[str, np.ndarray]:
        at, pieces = 0, []
        while at < len(data):
            found = self.charmap.longest(data, at)
            if found is None:
                length = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                found = (length, data[at : at + length])
            pieces.append((at, at + found[0], found[1].decode()))
            at += found[0]
        trim = self.spec.remove_extra_whitespaces
        out, ends, last_space = [], [0], trim
        lead = 0
        while trim and lead < len(pieces) and not pieces[lead][2].strip(" "):
            lead += 1
        pieces = pieces[lead:]
        if not pieces:
            return "", np.array([0])
        space = MARK if self.spec.escape_whitespaces else " "
        if self.spec.add_dummy_prefix:
            out.append(space)
            ends[0] = pieces[0][0]
            ends.append(pieces[0][0])
        else:
            ends[0] = pieces[0][0]
        for _, end, string in pieces:
            if trim and last_space:
                string = string.lstrip(" ")
            if string:
                out.append(string.replace(" ", space))
                ends[-1:] = [ends[-1]] + [ends[-1]] * (len(string) - 1)
                ends.append(end)
                last_space = string.endswith(" ")
            else:
                last_space = True
        text = "".join(out)
        if trim:
            while text.endswith(space):
                text = text[: -len(space)]
                ends.pop()
        return text, np.array(ends, np.int64)

    def _merged(self, chunk: str) -> list[str]:
        """Pieces of a chunk: the best-scored pair is merged first, the left one among equals."""
        if len(chunk) > LONG_CHUNK:
            return self._merged_long(chunk)
        parts, score = list(chunk), self.score
        while len(parts) > 1:
            best, place = None, -1
            left = parts[0]
            for i in range(1, len(parts)):
                right = parts[i]
                found = score.get(left + right)
                if found is not None and (best is None or found > best):
                    best, place = found, i
                left = right
            if best is None:
                break
            parts[place - 1 : place + 1] = [parts[place - 1] + parts[place]]
        return parts

    def _merged_long(self, chunk: str) -> list[str]:
        parts: list[str] = list(chunk)
        after = list(range(1, len(parts))) + [-1]
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-found, i, j, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, length = heapq.heappop(heap)
            if not parts[i] or not parts[j] or after[i] != j or len(parts[i]) + len(parts[j]) != length:
                continue
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p]

    def _merged_together(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, characters of each) of many chunks at once, -1 after a chunk's last symbol.

        One merge of every chunk per turn: its best-scored pair, the left one among equals; only the two pairs beside a
        merge are looked up again.
        """
        done, widths_done = symbols.copy(), (symbols >= 0).astype(np.int32)
        rows, now, widths = np.arange(len(symbols)), symbols, widths_done.copy()
        pairs = self._pairs(now[:, :-1], now[:, 1:])
        while now.shape[1] > 1:
            places = self.pair_place[pairs]
            at = places.argmin(axis=1)
            live = places[np.arange(len(now)), at] < NO_PAIR
            if not live.all():
                done[rows[~live], : now.shape[1]], widths_done[rows[~live], : now.shape[1]] = now[~live], widths[~live]
                rows, now, widths, pairs, at = (x[live] for x in (rows, now, widths, pairs, at))
                if not len(rows):
                    break
            own = np.arange(len(rows))
            now[own, at] = self.pair_made[pairs[own, at]]
            widths[own, at] += widths[own, at + 1]
            # close the gap behind the merge; a row gets shorter by one
            kept = np.arange(now.shape[1] - 1)[None, :]
            kept = kept + (kept > at[:, None])
            now, widths = np.take_along_axis(now, kept, 1), np.take_along_axis(widths, kept, 1)
            done[rows, now.shape[1] :], widths_done[rows, now.shape[1] :] = -1, 0
            if now.shape[1] > 1:
                kept = np.arange(now.shape[1] - 1)[None, :]
                pairs = np.take_along_axis(pairs, kept + (kept >= at[:, None]), 1)
                for beside in (at - 1, at):
                    inside = np.flatnonzero((beside >= 0) & (beside < now.shape[1] - 1))
                    place = beside[inside]
                    pairs[inside, place] = self._pairs(now[inside, place], now[inside, place + 1])
        done[rows, : now.shape[1]], widths_done[rows, : now.shape[1]] = now, widths
        return done, widths_done

    def _learn_together(self, chunks: list[str]) -> None:
        """Encode chunks of similar lengths and remember them."""
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        sizes = np.array([len(c) for c in chunks])
        inside = np.arange(sizes.max()) < sizes[:, None]
        symbols = np.full(inside.shape, -1, np.int32)
        symbols[inside] = self.symbol_of[codes]
        # characters that no piece has, or that are no piece of their own, are encoded one chunk at a time
        plain = ((symbols >= 0) == inside).all(axis=1)
        merged, widths = self._merged_together(symbols[plain])
        pieces = np.where(merged >= 0, self.piece_of[merged], -1)
        there = merged >= 0
        whole = (there == (pieces >= 0)).all(axis=1)
        places = np.flatnonzero(plain)
        for i in [*np.flatnonzero(~plain), *places[~whole]]:
            self._remember(chunks[i], *self._encode_chunk(chunks[i]))
        there, counts = there[whole], there[whole].sum(axis=1)
        begin = len(self.flat_ids) + np.cumsum(counts) - counts
        first = len(self.begin)
        self.flat_ids.frombytes(pieces[whole][there].astype(np.int32).tobytes())
        self.flat_chars.frombytes(widths[whole][there].astype(np.int32).tobytes())
        self.begin.frombytes(begin.astype(np.int64).tobytes())
        self.count.frombytes(counts.astype(np.int64).tobytes())
        self.cache.update((chunks[i], first + k) for k, i in enumerate(places[whole]))

    def _remember(self, chunk: str, ids, chars) -> None:
        self.cache[chunk] = len(self.begin)
        self.begin.append(len(self.flat_ids))
        self.count.append(len(ids))
        self.flat_ids.extend(ids)
        self.flat_chars.extend(chars)

    def _learn(self, chunks: list[str]) -> None:
        """Put chunks into the present generation: from the older one, or encoded anew."""
        fresh: dict[int, list[str]] = {}
        for chunk in chunks:
            known = self.older[0].get(chunk) if self.older else None
            if known is not None:
                _, ids, chars, begin, count = self.older
                own = slice(begin[known], begin[known] + count[known])
                self._remember(chunk, ids[own], chars[own])
            elif len(chunk) > LONG_CHUNK:
                self._remember(chunk, *self._encode_chunk(chunk))
            else:
                fresh.setdefault(-(-len(chunk) // 8), []).append(chunk)
        for alike in fresh.values():
            for at in range(0, len(alike), TOGETHER):
                self._learn_together(alike[at : at + TOGETHER])

    def _encode_chunk(self, chunk: str) -> tuple[list[int], list[int]]:
        ids, chars = [], []
        for part in self._merged(chunk):
            known = self.ids.get(part)
            if known is not None:
                ids.append(known)
                chars.append(len(part))
            elif self.fallback:
                data = part.encode()
                ids += [self.byte_ids[b] for b in data]
                # the last byte piece stands for the whole character
                chars += [0] * (len(data) - 1) + [1]
            elif ids and ids[-1] == self.unknown:
                chars[-1] += len(part)
            else:
                ids.append(self.unknown)
                chars.append(len(part))
        return ids, chars

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, ids, starts, ends): pieces of text i are offsets[i]:offsets[i + 1]."""
        if len(self.begin) > CACHED_CHUNKS:
            self._new_generation()
        chunks, chunk_counts, bounds = [], [], []
        for text in texts:
            norm, ends = self.normalise(text)
            bounds.append(ends)
            found = self.chunks.findall(norm)
            chunk_counts.append(len(found))
            chunks += found
        cache = self.cache
        self._learn(list(dict.fromkeys(c for c in chunks if c not in cache)))
        numbers = np.fromiter(map(cache.__getitem__, chunks), np.int64, len(chunks))
        for chunk in {c for c in chunks if len(c) > LONG_CHUNK}:
            del cache[chunk]
        begin, count = np.frombuffer(self.begin, np.int64), np.frombuffer(self.count, np.int64)
        lengths = count[numbers] if len(numbers) else np.zeros(0, np.int64)
        total = int(lengths.sum())
        first = np.cumsum(lengths) - lengths
        at = np.repeat(begin[numbers] - first, lengths) + np.arange(total) if total else np.zeros(0, np.int64)
        ids = np.frombuffer(self.flat_ids, np.int32)[at] if total else np.zeros(0, np.int32)
        chars = np.frombuffer(self.flat_chars, np.int32)[at] if total else np.zeros(0, np.int32)
        del begin, count
        chunk_edges = np.append(0, np.cumsum(chunk_counts)).astype(np.int64)
        offsets = np.append(first, total)[chunk_edges]
        # boundaries of all texts in a row; a text of n characters has n + 1
        shift = np.append(0, np.cumsum([len(b) for b in bounds]))[:-1]
        per_text = np.diff(offsets)
        reached = np.cumsum(chars) if total else np.zeros(0, np.int64)
        base = np.append(0, reached)[offsets[:-1]]
        inside = reached - np.repeat(base, per_text)
        bound = np.concatenate(bounds) if bounds else np.zeros(0, np.int64)
        where = inside + np.repeat(shift, per_text)
        return offsets, ids, bound[where - chars].astype(np.int64), bound[where].astype(np.int64)

    def decode(self, ids: list[int]) -> bytes:
        """The text of piece ids in UTF-8; bytes that form no character become U+FFFD each."""
        if ids and not self.spec.remove_extra_whitespaces and self.bytes_of.keys().isdisjoint(ids):
            shown = self.shown
            first = shown[ids[0]]
            if first and self.spec.add_dummy_prefix and self.surface[ids[0]].startswith(MARK.encode()):
                first = first[1:]
            elif not first:
                return self._decode_runs(ids)
            return first + b"".join([shown[i] for i in ids[1:]])
        return self._decode_runs(ids)

    def _decode_runs(self, ids: list[int]) -> bytes:
        shown, bytes_of = self.shown, self.bytes_of
        out: list[bytes] = []
        run = bytearray()
        at_start = True
        for i in ids:
            byte = bytes_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_repaired(bytes(run)))
                run.clear()
                at_start = False
            piece = shown[i]
            if at_start and piece:
                at_start = False
                if self.spec.add_dummy_prefix or self.spec.remove_extra_whitespaces:
                    if self.surface[i].startswith(MARK.encode()):
                        piece = piece[1:]
                        at_start = self.spec.remove_extra_whitespaces and not piece
            out.append(piece)
        if run:
            out.append(_repaired(bytes(run)))
        return b"".join(out)


def _repaired(data: bytes) -> bytes:
    try:
        data.decode()
        return data
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for length in (1, 2, 3, 4):
                piece = data[at : at + length]
                try:
                    piece.decode()
                except UnicodeDecodeError:
                    continue
                break
            else:
                piece, length = REPLACEMENT, 1
            out.append(piece)
            at += length
        return b"".join(out)


def _model_bytes(model: str | bytes) -> bytes:
    if isinstance(model, bytes):
        return model
    with open(model, "rb") as f:
        return f.read()


PIECES = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def encode(
    docs: DataFrame, model: str | bytes, id_col: str = "doc_id", text_col: str = "text", with_decoded: bool = False
) -> DataFrame:
    """(doc_id, ids, starts, ends): piece ids of every text and the original bytes each stands for.

    ``model`` is the model file's content, or its path on the driver; the content (a vocabulary, its
    size does not depend on the data) travels with the job.  ``with_decoded`` adds ``decoded``, the text
    decoded from the ids, in the same pass.  A null text counts as empty and has no pieces; repeated
    rows stay repeated; other columns are not read.
    """
    content = _model_bytes(model)
    names = ["doc_id", "ids", "starts", "ends", *(["decoded"] if with_decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(content)
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                offsets, ids, starts, ends = codec.encode([t or "" for t in texts])
                edges = pa.array(offsets, pa.int32())
                columns = [pa.ListArray.from_arrays(edges, pa.array(v, pa.int32())) for v in (ids, starts, ends)]
                if with_decoded:
                    pieces = ids.tolist()
                    decoded = (codec.decode(pieces[a:b]) for a, b in zip(offsets[:-1], offsets[1:]))
                    columns.append(pa.array([d.decode() for d in decoded], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, PIECES + (", decoded string" if with_decoded else ""))


def decode(encoded: DataFrame, model: str | bytes) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its column ``ids``; null ids give an empty text.

    A column ``decoded`` that is there already is replaced.
    """
    content = _model_bytes(model)
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(content)
        for batch in batches:
            place = batch.schema.get_field_index("ids")
            decoded = [codec.decode(i.values.to_pylist() if i.is_valid else []) for i in batch.column(place)]
            columns = [*batch.columns, pa.array([d.decode() for d in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "decoded"])

    slim = encoded.select(*(F.col(f"`{c}`") for c in names))
    schema = T.StructType([*slim.schema.fields, T.StructField("decoded", T.StringType())])
    return slim.mapInArrow(run, schema)
