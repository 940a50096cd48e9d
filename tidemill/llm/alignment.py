"""Two tokenizers' tokens of the same text, aligned by the bytes they stand for.

A is a byte-level BPE of the ``tokenizers`` library, B a sentencepiece model. A
text is encoded as " " + text by A and as text by B, which adds that space
itself. The libraries' own character spans are the coarse cuts: where one token's
span ends and the next one's begins, there is a cut. They can't tell tokens
apart that share a character (parts of one in several bytes, byte fallback);
between those, the decoded bytes of the tokens say where each ends. Both lists
of ends are then merged: where both tokenizers end a token a group ends, and each
stretch between two neighbouring ends lies in one token of A and one of B, which
is a link.

Neither tokenizer has a token that goes on over a space after something that is
no space (A's pattern and B's pieces have spaces in front only, which is checked for B), so texts are cut there into words.
A's pattern also parts a letter from a mark after it and a line's end from what is before it. Texts are
cut there too where no piece of B has both in a row, so that a word is the same whatever mark or line follows.
Each worker aligns a word once and remembers it.

How many documents hold a pair of ids linked is counted within each task first.
The counts of all pairs then go back to the documents a part at a time, so that
no worker holds more than one part.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import kernel
from tidemill.llm.work import own_columns, settled

#: Where the tokenizers' files are, and which are A and B.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A worker remembers so many words, and so many bytes of them; then it keeps those it has used again.
WORDS, WORD_BYTES = 1 << 19, 1 << 25
#: Words that are looked up at once, and those that are encoded at once.
AT_ONCE, ENCODED_AT_ONCE = 1 << 16, 1 << 14
#: A pair of ids is a << ID | b.
ID = 24
#: Words that make one text for the tokenizers, and what goes before each that has no space in front, as it can't follow every word.
TOGETHER, LEAD = 64, b" a"
#: The counts of so many pairs go to the workers at once; more take further passes over the stored links.
PAIRS_AT_ONCE = 1 << 21
#: Bytes after which a space isn't cut: white space, controls, and what may end a white-space character of several bytes.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x21), 0x7F]] = True
#: Characters below this have two bytes at most. Of these, the letters; and the marks of ASCII.
LATIN = 0x240
_LETTERS = np.array([chr(c).isalpha() for c in range(LATIN)])
_MARKS = np.array([0x20 < c < 0x7F and not chr(c).isalnum() for c in range(256)])


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin ones for themselves, 256 and on for the others."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def token_ends(starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray, first: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The byte at which each token ends.

    starts, ends: the tokens' spans in characters; at: the byte at which each
    character begins; sizes: how many bytes the tokens stand for; first: whether
    a token is a text's first; begin: the byte at which its text begins. A span's end counts where it isn't
    empty and the next one begins there; elsewhere the tokens' own bytes do, from
    the last end that counts.
    """
    n = np.arange(len(starts))
    last = np.append(first[1:], True)
    sure = (ends > starts) & (last | (np.append(starts[1:], -1) == ends))
    total = np.cumsum(sizes)
    shift = np.where(sure, at[ends] - total, begin - (total - sizes))
    return shift[np.maximum.accumulate(np.where(sure | first, n, 0))] + total


class Vocabulary:
    """The bytes that each id stands for."""

    def __init__(self, entries: Sequence[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        return self.data[np.arange(int(size.sum())) + np.repeat(self.start[ids] - (np.cumsum(size) - size), size)]


def _flat(lists, sizes: np.ndarray) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))


def _put(array: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
    """The array with more at this place; where it is too short, a copy twice as long."""
    if at + len(more) > len(array):
        array, short = np.zeros((2 * (at + len(more)), *array.shape[1:]), array.dtype), array
        array[:at] = short[:at]
    array[at : at + len(more)] = more
    return array


def letters_apart(pieces: Sequence[str]) -> np.ndarray:
    """For each character below LATIN and each of ASCII, whether the first is a letter, the second a mark, and no piece has both in a row, or LEAD's last and the mark."""
    apart = _LETTERS[:, None] & _MARKS[:128]
    for x, y in {pair for p in pieces for pair in zip(p, p[1:], strict=False)}:
        if ord(x) < LATIN and ord(y) < 128:
            apart[ord(x), ord(y)] = False
    return apart & apart[LEAD[-1]]


class Aligner:
    """Both tokenizers, and the words that this worker has aligned so far."""

    def __init__(self, a_json: str, b_model: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer, pre_tokenizers

        self.a, self.b = Tokenizer.from_str(a_json), SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        code = byte_level()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = Vocabulary([bytes(code[c] for c in x) if all(c in code for c in x) else x.encode() for x in entries])
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = Vocabulary([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)])
        # otherwise a token may go on over a space, or over what the pattern parts
        pattern = isinstance(self.a.pre_tokenizer, pre_tokenizers.ByteLevel) and self.a.pre_tokenizer.use_regex and all(x.special for x in self.a.get_added_tokens_decoder().values())
        self.cuts = pattern and self.a.normalizer is None and not any("▁" in x.lstrip("▁") for x in pieces)
        self.apart, self.lines = letters_apart(pieces), not any("\n" in x for x in pieces)
        most = max(len(entries), len(pieces))
        if most > 1 << ID:
            raise ValueError("a vocabulary is too large for a pair of ids")
        width = len(str(most)) + 1
        self.written = np.array([[f"{i}{mark}" for i in range(most)] for mark in ",|;"], dtype=f"S{width}").view(np.uint8).reshape(3, most, width)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # in the order of the numbers
        self.groups: list[str] = []
        # by number, longer than they are filled; of counts: tokens of A, of B, groups, links, and whether the bytes differ
        self.counts, self.starts, self.uses = np.zeros((0, 5), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.links, self.n_links, self.size = np.zeros(0, np.uint64), 0, 0

    def shrink(self) -> None:
        """Keeps the words that have been used again, half of WORDS at most."""
        if self.size <= WORD_BYTES and len(self.known) <= WORDS:
            return
        least = 2
        while (self.uses >= least).sum() > WORDS // 2:
            least *= 2
        keep, words = np.flatnonzero(self.uses >= least), list(self.known)
        words, groups = [words[k] for k in keep.tolist()], [self.groups[k] for k in keep.tolist()]
        counts, links, uses = self.counts[keep], self.links_of(keep), self.uses[keep] // 2
        self.forget()
        if sum(map(len, words)) <= WORD_BYTES // 2:
            self._add(words, counts, groups, links)
            self.uses[: len(uses)] = uses

    def learn(self, words: list[bytes]) -> None:
        """Aligns words, those that end visibly in texts of TOGETHER words."""
        last = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
        seen = ((last > 0x20) & (last < 0x7F) & self.cuts).tolist()
        plain, alone = list(compress(words, seen)), [[w] for w, s in zip(words, seen, strict=True) if not s]
        together = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        failed = self._learn(together + alone)
        for unit in failed:
            if len(unit) == 1:
                self._add(unit, np.array([[0, 0, 0, 0, 1]]), [""], np.zeros(0, np.uint64))
        if again := [[w] for unit in failed if len(unit) > 1 for w in unit]:
            for unit in self._learn(again):
                self._add(unit, np.array([[0, 0, 0, 0, 1]]), [""], np.zeros(0, np.uint64))

    def _add(self, words: list[bytes], counts: np.ndarray, groups: list[str], links: np.ndarray) -> None:
        n = len(self.groups)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.groups += groups
        self.size += sum(map(len, words))
        self.counts = _put(self.counts, n, counts)
        self.starts = _put(self.starts, n, self.n_links + np.cumsum(counts[:, 3]) - counts[:, 3])
        self.uses = _put(self.uses, n, np.zeros(len(words), np.int64))
        self.links = _put(self.links, self.n_links, links)
        self.n_links += len(links)

    def _tokens(self, ids: list, spans: list, vocabulary: Vocabulary, data: np.ndarray, begin: np.ndarray, at: np.ndarray, base: np.ndarray, shift: int):
        """(ids, text, end byte) of all tokens, and which texts the tokens' bytes are."""
        n = np.array([len(x) for x in ids], np.int64)
        k, text = _flat(ids, n), np.repeat(np.arange(len(n)), n)
        span = _flat(chain.from_iterable(spans), 2 * n).reshape(-1, 2) + shift  # B doesn't see the first space
        first = np.ones(len(text), dtype=bool)
        first[1:] = text[1:] != text[:-1]
        span[first, 0] = 0
        size, own = vocabulary.size[k], np.diff(begin)
        ok = np.bincount(text, size, len(n)).astype(np.int64) == own
        differ = vocabulary.decode(k[ok[text]]) != data[np.repeat(ok, own)]
        ok[np.repeat(np.flatnonzero(ok), own[ok])[differ]] = False
        return k, text, token_ends(base[text] + span[:, 0], base[text] + span[:, 1], size, first, at, begin[text]), ok

    def _learn(self, units: list[list[bytes]]) -> list[list[bytes]]:
        """Aligns the words of some texts; returns the texts whose words aren't cut by tokens, or that a tokenizer changes."""
        if not units:
            return []
        given, units = units, [[x for w in u for x in ((w,) if w[:1] == b" " else (LEAD, w))] for u in units]
        joined = [b"".join(u) for u in units]
        texts = [x.decode() for x in joined]
        data = np.frombuffer(b"".join(joined), np.uint8)
        begin = np.cumsum([0, *map(len, joined)])
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        base = np.searchsorted(at, begin[:-1])
        by_a = self.a.encode_batch(texts, add_special_tokens=False)
        by_b = self.b.encode([t[1:] for t in texts], return_type="offset_mapping", num_threads=1)
        a, a_text, a_end, a_ok = self._tokens([x.ids for x in by_a], [x.offsets for x in by_a], self.a_bytes, data, begin, at, base, 0)
        b, b_text, b_end, b_ok = self._tokens([x["ids"] for x in by_b], [x["offsets"] for x in by_b], self.b_bytes, data, begin, at, base, 1)

        of_text = np.repeat(np.arange(len(units)), [len(u) for u in units])
        words = list(chain.from_iterable(units))
        word_end = np.cumsum(list(map(len, words)))
        ok = a_ok & b_ok
        a_ends, b_ends = np.zeros((2, len(data) + 1), dtype=bool)
        a_ends[a_end[a_ok[a_text]]], b_ends[b_end[b_ok[b_text]]] = True, True
        ok[of_text[~(a_ends & b_ends)[word_end]]] = False
        failed = [u for u, good in zip(given, ok.tolist(), strict=True) if not good]
        if failed:
            a, a_end, b, b_end = a[ok[a_text]], a_end[ok[a_text]], b[ok[b_text]], b_end[ok[b_text]]
            for x in (a_ends, b_ends):
                x[1:][np.repeat(~ok, np.diff(begin))] = False
            words, word_end = list(compress(words, ok[of_text].tolist())), word_end[ok[of_text]]
        if not words:
            return failed

        ends, cuts = np.flatnonzero(a_ends | b_ends), np.flatnonzero(a_ends & b_ends)  # stretches between two ends are links, those between two cuts groups
        links = a[np.searchsorted(a_end, ends)].astype(np.uint64) << np.uint64(ID) | b[np.searchsorted(b_end, ends)].astype(np.uint64)
        # how many cuts are before each byte says which group a token is in, as ends in order say which word
        before = np.cumsum((a_ends & b_ends)[:-1])
        counts = np.stack([np.diff(np.searchsorted(x, word_end, side="right"), prepend=0) for x in (a_end, b_end, cuts, ends)] + [np.zeros(len(words), np.int64)], axis=1)
        side = np.concatenate([2 * before[a_end - 1], 2 * before[b_end - 1] + 1])
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.concatenate([a, b])[order]
        closes = np.append(side[1:] != side[:-1], True)
        written = self.written[np.where(closes, 1 + side % 2, 0), ids]
        stop = np.cumsum(np.count_nonzero(written, axis=1))[np.cumsum(counts[:, 0] + counts[:, 1]) - 1].tolist()
        text = written[written != 0].tobytes().decode()
        groups = [text[x:y] for x, y in zip([0, *stop[:-1]], stop, strict=True)]
        lead = np.array([w[0] != 0x20 for w in words[1:]] + [False])  # only LEAD goes before such words
        if lead.any():
            links, counts = links[np.repeat(~lead, counts[:, 3])], counts[~lead]
            words, groups = (list(compress(x, (~lead).tolist())) for x in (words, groups))
        self._add(words, counts, groups, links)
        return failed

    def look_up(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """The numbers of distinct words, which are used so many times; new ones are learned first."""
        found = list(map(self.known.get, words))
        missing = [i for i, k in enumerate(found) if k is None]
        for k in range(0, len(missing), ENCODED_AT_ONCE):
            self.learn([words[i] for i in missing[k : k + ENCODED_AT_ONCE]])
        for i in missing:
            found[i] = self.known[words[i]]
        out = np.fromiter(found, np.int64, len(words))
        self.uses[out] += times
        return out

    def links_of(self, words: np.ndarray) -> np.ndarray:
        """All links of these words, a << ID | b."""
        n = self.counts[words, 3]
        at = np.arange(int(n.sum())) + np.repeat(self.starts[words] - (np.cumsum(n) - n), n)
        return self.links[at]


def word_starts(data: np.ndarray, begin: np.ndarray, cuts: bool = True, apart: np.ndarray | None = None, lines: bool = False) -> np.ndarray:
    """Where words begin: with each text, and at spaces that follow something visible and aren't a text's last byte. Texts begin with a space.

    lines: also at line ends that follow something visible. apart: also at marks
    that follow a letter, where this table says so.
    """
    if not cuts:
        return begin
    space = data == 0x20
    space[begin[1:] - 1], space[-1] = False, False
    p = np.flatnonzero(space | (data == 0x0A) if lines else space)
    p = p[~_BLANK[data[p - 1]]]
    # of the white space in several bytes, one of these bytes is the first
    long = (data[p - 1] >= 0x80) & ((data[np.maximum(p - 2, 0)] == 0xC2) | np.isin(data[np.maximum(p - 3, 0)], (0xE1, 0xE2, 0xE3)))
    starts = np.zeros(len(data), dtype=bool)
    starts[p[~long]] = True
    if apart is not None:
        p = np.flatnonzero(_MARKS[data])
        c, first = data[p - 1].astype(np.int64), data[p - 2].astype(np.int64)  # no text begins with a mark
        two = (c >= 0x80) & (first >= 0xC2) & (first < 0xC0 | LATIN >> 6)
        c = np.where(two, (first & 0x1F) << 6 | c & 0x3F, np.where(c < 0x80, c, 0))
        starts[p[apart[c, data[p]]]] = True
    starts[begin] = True
    return np.flatnonzero(starts)


def pack(pairs: np.ndarray, times: np.ndarray) -> bytes:
    """Pairs that rise, and how often each is linked, by bytes of equal weight, which compresses well."""
    both = np.concatenate([np.diff(pairs, prepend=np.uint64(0)), times.astype(np.uint64)])
    return pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 16 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, 2 * n)
    both = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(both[:n], dtype=np.uint64), both[n:].astype(np.int64)


_ROW = pa.schema([("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("n_pairs", pa.int64()), ("pairs", pa.binary())])
ALIGNED = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, n_pairs bigint, pairs binary"
_NONE = (0, 0, 0, 0, "", 0, b"")


class _Text:
    """What is known of a text so far: its words come in one part, or in several if it is long."""

    def __init__(self):
        self.total, self.groups, self.links = np.zeros(5, np.int64), [], []

    def row(self) -> tuple:
        if self.total[4] or not self.links:
            return _NONE
        pairs, times = self.links[0]
        if len(self.links) > 1:
            pairs, place = np.unique(np.concatenate([p for p, _ in self.links]), return_inverse=True)
            times = np.bincount(place, np.concatenate([t for _, t in self.links])).astype(np.int64)
        return (*self.total[:4].tolist(), "".join(self.groups)[:-1], len(pairs), pack(pairs, times))


def align_texts(aligner: Aligner, texts: Sequence[bytes]) -> list[tuple]:
    """The row of each text: counts of tokens, groups and links, the groups, and its distinct pairs with their numbers."""
    out = [_Text() for _ in texts]
    rows = [(row, b" " + text) for row, text in zip(out, texts, strict=True) if text]
    whole = b"".join([x for _, x in rows])
    begin = np.cumsum([0, *(len(x) for _, x in rows)])[:-1]
    starts = word_starts(np.frombuffer(whole, np.uint8), begin, aligner.cuts, aligner.apart, aligner.lines) if rows else begin
    for k in range(0, len(starts), AT_ONCE):
        some = starts[k : k + AT_ONCE]
        edges = np.append(some, starts[k + AT_ONCE] if k + AT_ONCE < len(starts) else len(whole))
        distinct = pa.Array.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(edges), pa.py_buffer(whole)]).dictionary_encode()
        place = distinct.indices.to_numpy()
        aligner.shrink()
        data, at = kernel.buffers(distinct.dictionary)
        data, at = data.tobytes(), at.tolist()
        numbers = aligner.look_up([data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)], np.bincount(place))
        words = numbers[place]
        row = np.searchsorted(begin, some, side="right") - 1
        low, counts = int(row[0]), aligner.counts[words]
        edge = np.searchsorted(row, np.arange(low, int(row[-1]) + 2)).tolist()
        key = np.sort((np.repeat(row - low, counts[:, 3]) << 2 * ID).astype(np.uint64) | aligner.links_of(words))
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(new, len(key)))
        key = key[new]
        cut = np.searchsorted(key, np.arange(len(edge), dtype=np.uint64) << np.uint64(2 * ID)).tolist()
        total, key = np.add.reduceat(counts, edge[:-1], axis=0), key & np.uint64((1 << 2 * ID) - 1)
        written, at = kernel.buffers(pa.array([aligner.groups[n] for n in numbers.tolist()], pa.large_string()).take(distinct.indices))
        for j, (x, y, u, v) in enumerate(zip(edge[:-1], edge[1:], cut[:-1], cut[1:], strict=True)):
            text = rows[low + j][0]
            text.total += total[j]
            text.groups.append(written[at[x] : at[y]].tobytes().decode())
            text.links.append((key[u:v], times[u:v]))
    return [text.row() for text in out]


#: The tokenizers of this worker, by the number of their broadcast: tasks and batches share them.
_loaded: dict[str, Aligner] = {}


def _aligner(key: str, shared) -> Aligner:
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Aligner(*shared.value)
    return _loaded[key]


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER, a: str = FILE_A, b: str = FILE_B) -> DataFrame:
    """One row per row of docs: id, n_a and n_b (tokens), n_groups, n_links, groups, and its distinct linked pairs (n_pairs, and pairs packed).

    groups is ``a1,a2|b1;a3|b2,b3``: the ids of A and B of each group. Null and
    empty texts, and those that either tokenizer changes (its tokens' bytes
    differ from " " + text, as where a text has U+2581 itself), have no tokens:
    zeros and an empty groups. Special tokens' strings are plain text. Texts of
    any length are taken whole; a word that long is one piece of work. Null ids
    and repeated rows stay; other columns aren't read; an empty table gives an
    empty result. Rows don't move. The driver reads the two files, and they go to
    the workers.
    """
    spark = docs.sparkSession
    with open(f"{folder}/{a}", encoding="utf-8") as f, open(f"{folder}/{b}", "rb") as g:
        shared, key = spark.sparkContext.broadcast((f.read(), g.read())), uuid.uuid4().hex

    def run(batches):
        aligner = _aligner(key, shared)
        for batch in batches:
            for x, y in kernel.runs(batch.column(1)):
                part = batch.slice(x, y - x)
                data, at = kernel.buffers(part.column(1))
                rows = align_texts(aligner, [data[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["id", *_ROW.names])

    given = own_columns(docs, {"id": id_col, "text": text_col}).withColumn("id", F.col("id").cast("bigint"))
    return given.mapInArrow(run, ALIGNED)


def _count_pairs(batches):
    """How many rows hold each pair, a batch at a time, and then all that this task has, as long as they are few."""
    pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(pairs.view(np.int64)), pa.array(counts)], ["pair", "n"])

    waiting, size = [], 0

    def merged():
        all_pairs, place = np.unique(np.concatenate([pairs, *waiting]), return_inverse=True)
        return all_pairs, np.bincount(place, np.concatenate([counts, np.ones(size, np.int64)]), len(all_pairs)).astype(np.int64)

    for batch in batches:
        for data, n in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            waiting.append(unpack(data.as_buffer(), n)[0])
            size += n
            if size > 1 << 20:
                pairs, counts = merged()
                waiting, size = [], 0
                if len(pairs) > PAIRS_AT_ONCE:
                    yield rows()
                    pairs, counts = pairs[:0], counts[:0]
    pairs, counts = merged()
    yield rows()


def link_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many rows of align() each pair of ids is linked, and whether no other pair of its a is in more."""
    held = aligned.where("n_pairs > 0").select("pairs", "n_pairs").mapInArrow(_count_pairs, "pair bigint, n bigint")
    counts = settled(held.groupBy("pair").agg(F.sum("n").alias("n")))
    # a's pairs are B's vocabulary at most, and maxima are taken before the shuffle
    most = counts.groupBy(F.shiftright("pair", ID).alias("a")).agg(F.max("n").alias("most"))
    both = counts.withColumn("a", F.shiftright("pair", ID)).join(most, "a")
    return both.select("a", F.col("pair").bitwiseAND((1 << ID) - 1).alias("b"), "n", (F.col("n") == F.col("most")).alias("best"))


#: The part of the counts that this worker has loaded last.
_part: dict[str, tuple] = {}


def _scored(spark: SparkSession, part: pa.Table):
    """A column of (n_best, count_sum) from pairs and n_pairs, over the pairs of this part."""
    keys = (part["a"].to_numpy().astype(np.uint64) << np.uint64(ID)) | part["b"].to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    shared, key = spark.sparkContext.broadcast((keys[order], part["n"].to_numpy()[order], part["best"].to_numpy(zero_copy_only=False)[order])), uuid.uuid4().hex

    def score(data: pa.Array, sizes: pa.Array) -> pa.Array:
        if key not in _part:
            _part.clear()
            _part[key] = shared.value
        known, counts, best = _part[key]
        out = np.zeros((len(data), 2), np.int64)
        for k, (x, n) in enumerate(zip(data, sizes.to_pylist(), strict=True)):
            if n and len(known):
                pairs, times = unpack(x.as_buffer(), n)
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                times = times * (known[at] == pairs)
                out[k] = (times * best[at]).sum(), (times * counts[at]).sum()
        return pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["n_best", "count_sum"])

    return F.arrow_udf(score, "struct<n_best:bigint,count_sum:bigint>")


def with_link_counts(aligned: DataFrame) -> DataFrame:
    """align()'s rows, settled, without pairs and with n_best and count_sum over their links.

    n_best counts the links whose pair is in as many rows as any pair of its id
    of A, ties included; count_sum adds up in how many rows each link's pair is.
    Rows without tokens have zeros; an empty table gives an empty result. Up to
    PAIRS_AT_ONCE distinct pairs, rows stay where they are; more take a pass over
    the stored pairs for each such part, whose sums are then added up by row.
    """
    spark = aligned.sparkSession
    rest = [c for c in aligned.columns if c not in ("pairs", "n_pairs")]
    counts = link_counts(aligned)
    parts = max(1, -(-counts.count() // PAIRS_AT_ONCE))
    if parts == 1:
        return aligned.withColumn("x", _scored(spark, counts.toArrow())("pairs", "n_pairs")).select(*rest, "x.*")
    place = F.pmod(F.xxhash64("a", "b"), F.lit(parts))
    counts = settled(counts.withColumn("place", place))
    stored = settled(aligned.withColumn("row", F.monotonically_increasing_id()))  # settled, so each pass sees the same numbers
    sums = None
    for k in range(parts):
        found = stored.select("row", _scored(spark, counts.where(F.col("place") == k).toArrow())("pairs", "n_pairs").alias("x")).select("row", "x.*")
        sums = found if sums is None else sums.union(found)
    added = sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return stored.join(added, "row").select(*rest, "n_best", "count_sum")
