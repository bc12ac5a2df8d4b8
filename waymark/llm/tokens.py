"""Token counts of whole texts with a public tokenizer's own library, inside Arrow functions."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Characters of text taken together, of the windows of a longer text, and of what the library gets at once: it holds
#: over a hundred bytes for each id until a call ends.
GROUP, WINDOW, CALL = 1 << 22, 1 << 21, 1 << 18
#: Characters of the longest piece that is remembered, and pieces remembered by each Python worker (twice as many for
#: a while): some 20 MB.
SHORT, REMEMBERED = 48, 50_000
#: A place where the byte-level BPE's pre-tokenizer always starts a new word: before one space that stands between two
#: characters which are no white space. No added token has a space in it, so none is cut either.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: The same for texts without such a space: between a letter and an ideographic stop.
STOP = re.compile(r"(?<=[^\W\d_])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
#: Without two characters of white space in a row, every space and every line feed begins a word.
RUN = re.compile(r"\s\s")
#: A piece with no white space but a line feed before it.
PLAIN = re.compile(r"\n?\S+")
#: Marks that always begin a new word after a letter, up to the last letter that every library's Unicode tables have.
MARKS, LETTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", "\u024f"
#: A space and a line feed as byte-level vocabularies write them.
SPACE, FEED = "\u0120", "\u010a"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    """The encoder of a .json file; one in each Python worker."""
    return Encoder(path)


def windows(text: str, most: int = WINDOW) -> Iterator[str]:
    """Cut a text at safe places into parts of about `most` characters; without such a place it stays whole."""
    start = 0
    while len(text) - start > most:
        found = SAFE.search(text, start + most - 1) or STOP.search(text, start + most - 1)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class Encoder:
    """Token ids of whole texts. Texts are cut at their safe places and each different piece of a group of texts goes to
    the library once; pieces that come again are remembered. Only byte-level pre-tokenizers with their own word pattern,
    without a normalizer or a prefix space, are cut; texts of any other tokenizer go to the library whole. Threads are
    Spark's to give."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        self.cuts, self.tails = cuttable(settings), tailed(settings)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token[:1] in (SPACE, FEED)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts, about CALL characters at a time."""
        out, batch, size = [], [], 0
        for k, text in enumerate(texts, 1):
            batch.append(text)
            size += len(text) + 16
            if size >= CALL or k == len(texts):
                out += [ids_bytes(got.ids) for got in self.library.encode_batch_fast(batch, add_special_tokens=False)]
                batch, size = [], 0
        return out

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces. Letters with marks behind them are two words, of which the first is often known."""
        out, tails, plain, other, size = {}, [], {}, [], 0
        for piece in pieces:
            if piece.isalpha():
                plain[piece] = None
                continue
            stem = piece.rstrip(MARKS) if self.tails else piece
            if "" != stem != piece and stem[-1] <= LETTERS and (stem[1:] if stem[0] == "\n" else stem).isalpha():
                tails.append((piece, stem, piece[len(stem) :]))
            elif PLAIN.fullmatch(piece):
                plain[piece] = None
            else:
                other.append(piece)
        known, young, old = {}, self.young.get, self.old.get
        for _, stem, _ in tails:
            if stem not in plain and stem not in known:
                ids = young(stem) or old(stem)
                if ids is None:
                    plain[stem] = None
                else:
                    known[stem] = ids
        words, plain = plain, []
        for piece in words:
            plain.append(piece)
            size += len(piece) + 1
            if size >= CALL:
                out.update(self._learn_plain(plain))
                plain, size = [], 0
        out.update(self._learn_plain(plain))
        out.update(self._learn_each(other))
        marks = list({tail for _, _, tail in tails})
        ends = dict(zip(marks, self._library(marks), strict=True))
        known.update((stem, out[stem]) for _, stem, _ in tails if stem not in known)
        out.update((piece, known[stem] + ends[tail]) for piece, stem, tail in tails)
        return out

    def _learn_plain(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces without white space inside, encoded as one text: an id whose token begins with the white
        space before a piece is that piece's first. If these don't tally, each piece is encoded alone."""
        text = "".join([p if p[0] == "\n" else " " + p for p in pieces])
        ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        found = ids_bytes(ids)
        starts = np.flatnonzero(self.opens[np.frombuffer(found, "<u4")])
        if len(starts) != len(pieces) or starts[:1].any():
            return self._learn_each(pieces)
        ends = (4 * starts).tolist() + [len(found)]
        return {p: found[i:j] for p, i, j in zip(pieces, ends, ends[1:], strict=False)}

    def _learn_each(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces, each encoded as a text of its own."""
        return dict(zip(pieces, self._library([p if p[:1] == "\n" else " " + p for p in pieces]), strict=True))

    def _ids_of(self, pieces: list[str], often: list[bool]) -> list[bytes]:
        """The ids of different pieces; those that are met often are remembered, and forgotten when they stay away."""
        young, old = self.young.get, self.old.get
        found = [young(p) or old(p) for p in pieces]
        new = self._learn([p for p, ids in zip(pieces, found, strict=True) if ids is None])
        out = [new[p] if ids is None else ids for p, ids in zip(pieces, found, strict=True)]
        self.young.update((p, ids) for p, ids, again in zip(pieces, out, often, strict=True) if again and len(p) <= SHORT)
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return out

    def _group(self, texts: list[str], want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """How many ids each text has, and the ids of all in a row."""
        if not self.cuts:
            found = self._library(texts)
            return np.fromiter(map(len, found), np.int64, len(texts)) // 4, np.frombuffer(b"".join(found), "<u4") if want_ids else None
        odd = np.fromiter((RUN.search(t) is not None for t in texts), bool, len(texts))
        # Texts without runs of white space first: Arrow cuts these by itself.
        order = np.argsort(odd, kind="stable")
        even = pa.array([texts[i] for i in order[: int((~odd).sum())].tolist()], pa.string())
        lists = pa.concat_arrays([
            pc.split_pattern(pc.replace_substring(even, "\n", " \n"), " "),
            pa.array([SAFE.split(texts[i]) for i in order[len(even) :].tolist()], pa.list_(pa.string())),
        ])
        heads = lists.offsets.to_numpy()[:-1]
        words = lists.flatten()
        table = words.dictionary_encode()
        codes = table.indices.to_numpy(zero_copy_only=False).copy()
        # A text's first piece has no space before it, so it is an entry of its own.
        first = words.take(pa.array(heads)).dictionary_encode()
        pieces, n = table.dictionary.to_numpy(zero_copy_only=False).tolist(), len(table.dictionary)
        codes[heads] = n + first.indices.to_numpy(zero_copy_only=False)
        counts = np.bincount(codes, minlength=n + len(first.dictionary))[:n]
        found, used = [b""] * n, np.flatnonzero(counts)
        for i, ids in zip(used.tolist(), self._ids_of([pieces[i] for i in used.tolist()], (counts[used] > 1).tolist()), strict=True):
            found[i] = ids
        found += self._library(first.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        lengths = np.add.reduceat(sizes[codes], heads)
        back = np.argsort(order, kind="stable")
        if not want_ids:
            return lengths[back], None
        ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(found), "<u4"))).take(pa.array(codes)).flatten()
        if odd.any():
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), ids).take(pa.array(back)).flatten()
        return lengths[back], ids.to_numpy()

    def encode_many(self, texts: list[str], want_ids: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """For groups of texts in a row: how many ids each text has, and all their ids as unsigned 32-bit numbers. A
        group has about GROUP characters; a longer text is one of its own, encoded by windows."""
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and size + len(texts[to]) <= GROUP:
                size += len(texts[to])
                to += 1
            if to > at:
                yield self._group(texts[at:to], want_ids)
                at = to
            else:
                parts = [self._group([part], want_ids) for part in (windows(texts[at]) if self.cuts else [texts[at]])]
                yield np.array([sum(int(n[0]) for n, _ in parts)]), np.concatenate([ids for _, ids in parts]) if want_ids else None
                at += 1

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return next(self.encode_many([text]))[1]


def cuttable(settings: dict) -> bool:
    """Whether a tokenizer file's words begin where SAFE and RUN have it."""
    before = settings.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    return bool(plain and settings.get("normalizer") is None and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in settings.get("added_tokens", ())))


def tailed(settings: dict) -> bool:
    """Whether no added token lies across the end of a word's letters or depends on what stands beside it."""
    return not any(t.get("single_word") or t["content"].rstrip(MARKS).isalpha() for t in settings.get("added_tokens", ()))


def ids_bytes(ids: list[int]) -> bytes:
    got = array("I", ids)
    if sys.byteorder == "big":
        got.byteswap()
    return got.tobytes()


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of docs.

    Null texts count as empty (0 bytes, 0 tokens); null ids stay null; repeated rows give repeated rows; other columns
    are not read. No shuffle: each task encodes the rows it reads. `tokenizer` is the path of a tokenizer file that is
    present wherever Python workers run.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(n for n, _ in encoder.encode_many(batch.column("text").to_pylist(), want_ids=False))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes")).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
