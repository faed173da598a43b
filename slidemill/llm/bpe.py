"""Operator 2, byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding.  A ``PrefixTable`` stores it: a token t ends
prefix i if the last token of prefix i - len(t) and t may stand side by side, that is, if merging by rank never joins bytes
across their border.  So appending bytes only adds entries, cutting only drops them, and after an edit entries are made anew
from its place until they agree with the old ones over the length of the longest token.  ``EditableText`` does the same for a
text of many pieces, as the pattern splits it.

Encoding of documents runs in Arrow batches: pieces repeat, so each task keeps a bounded table of those it has seen.

Defined cases: a null text is empty: no tokens, the hash of no bytes.  Ids are those of the tiktoken library without special
tokens.  Repeated rows are encoded each on its own; texts are encoded whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import extended, others

#: Pieces, and byte prefixes, after which the tables of those seen are renewed, and pairs of neighbours that are remembered.
KEPT, PREFIXES, PAIRS = 60_000, 300_000, 600_000
#: Letters and numbers of Unicode versions after 16.0, which the tokenizer's tables do not know as such.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf"
    "\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f"
    "\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24"
    "\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LATER = regex.compile(f"[{LATER}]")


#: Code points below this one are split by Python's own regular expressions, which are faster.
_NEAR = 0x250
_BEYOND = re.compile(f"[^\\x00-{chr(_NEAR - 1)}]")


def near(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of code points below _NEAR, its classes \\p{L}, \\p{N}, \\s and \\S spelled out; None if it has others."""
    spelled = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        spelled[name] = "".join(re.escape(chr(c)) for c in range(_NEAR) if regex.match(name, chr(c)))

    def inside(m: re.Match) -> str:
        out = m[0]
        for name, signs in spelled.items():
            out = out.replace(name, signs)
        return out.replace("[", "\x00")

    out = re.sub(r"\[[^\]]*\]", inside, pattern)
    for name, signs in spelled.items():
        out = out.replace(name, f"[{signs}]")
    out = out.replace(r"\S", f"[^{spelled[chr(92) + 's']}]").replace("\x00", "[")
    return None if re.search(r"\\[pPwWdDbBX]", out) else re.compile(out)


def _halves(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """What merging by rank makes of a token's bytes if only lower ranks may be used."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
        if best[0] >= rank:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class Vocabulary:
    """Ranks of tokens, how each was merged, and which may stand side by side."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.text_of = {r: str(r) for r in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.near = near(pattern)
        self.longest = max(map(len, ranks))
        self.made_of: dict[int, tuple[int, int]] = {}
        self.reachable = dict(ranks)
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = _halves(token, rank, ranks)
                if len(parts) == 2 and all(p in ranks for p in parts):
                    self.made_of[rank] = ranks[parts[0]], ranks[parts[1]]
                else:
                    del self.reachable[token]
        self.tried = 0
        #: For each token on the left, what is known of tokens on its right.
        self.beside: list[dict[int, bool]] = [{} for _ in range(max(self.bytes_of) + 1)]

    def forget(self) -> None:
        """Forget which tokens may stand side by side."""
        self.tried = 0
        for known in self.beside:
            known.clear()

    def _never_joined(self, left: int, right: int) -> bool:
        """Undo the merges on both sides of the border, latest first: no pair that faces each other there may merge before either side goes on.

        A pair (a, b) stands at the border until the next merge of a or b into what encloses it.  Ranks are times of merging, ties go to the left.
        """
        self.tried += 1
        if self.tried > PAIRS:
            self.forget()
        a, b = left, right
        end_a = end_b = float("inf")  # when a, and b, are merged into what encloses them
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < end_a and joined <= end_b:
                return False
            older_a, older_b = (a if a in self.made_of else -1), (b if b in self.made_of else -1)
            if older_a < 0 and older_b < 0:
                return True
            if older_a > older_b:
                end_a, a = a, self.made_of[a][1]
            else:
                end_b, b = b, self.made_of[b][0]


class PrefixTable:
    """The last token of each prefix of a piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        start = len(self.piece)
        self.piece += more
        self._fill(start + 1, len(self.piece) + 1)

    def _fill(self, start: int, end: int) -> None:
        v, piece, last = self.vocabulary, self.piece, self.last
        get, beside, longest = v.reachable.get, v.beside, v.longest
        for i in range(start, end):
            for j in range(i - 1, max(-1, i - 1 - longest), -1):
                t = get(piece[j:i])
                if t is not None:
                    if not j:
                        break
                    known = beside[last[j]]
                    fits = known.get(t)
                    if fits is None:
                        fits = known[t] = v._never_joined(last[j], t)
                    if fits:
                        break
            last.append(t)

    def cut(self, n: int) -> None:
        """Keep the first n bytes."""
        self.piece, self.last = self.piece[:n], self.last[: n + 1]

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put new in place of bytes start to end; returns how many entries were made anew."""
        rest, old = self.piece[end:], self.last
        self.piece, self.last = self.piece[:start] + new + rest, old[: start + 1]
        shift, same, made = len(new) - (end - start), 0, 0
        for i in range(start + 1, len(self.piece) + 1):
            self._fill(i, i + 1)
            t = self.last[i]
            made += 1
            # a token that begins before the edit says nothing of what follows it
            same = same + 1 if i - len(new) > start and old[i - shift] == t and len(self.vocabulary.bytes_of[t]) <= i - start - len(new) else 0
            if same >= self.vocabulary.longest:
                self.last += old[i - shift + 1 :]
                break
        return made

    def ids(self) -> list[int]:
        out, i = [], len(self.piece)
        while i:
            out.append(self.last[i])
            i -= len(self.vocabulary.bytes_of[self.last[i]])
        return out[::-1]


class Prefixes(dict):
    """The last token of byte prefixes, of all pieces together: made when first asked for, and each from the shorter ones it needs."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, prefix: bytes) -> int:
        v, n = self.vocabulary, len(prefix)
        get = v.reachable.get
        for j in range(max(0, n - v.longest), n):
            t = get(prefix[j:])
            if t is not None:
                if not j:
                    break
                left = self[prefix[:j]]
                known = v.beside[left]
                fits = known.get(t)
                if fits is None:
                    fits = known[t] = v._never_joined(left, t)
                if fits:
                    break
        self[prefix] = t
        return t


class Seen(dict):
    """Ids of pieces, made when first asked for; those asked for since the last renewal, and those of the time before, are at hand."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.before = vocabulary, {}
        self.prefixes = Prefixes(vocabulary)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > KEPT:
            self.renew()
        ids = self.before.get(piece)
        if ids is None:
            ids = self._made(piece.encode())
        self[piece] = ids
        return ids

    def _made(self, data: bytes) -> tuple[int, ...]:
        whole = self.vocabulary.ranks.get(data)
        if whole is not None:
            return (whole,)
        if len(data) > 200:
            return tuple(PrefixTable(self.vocabulary, data).ids())
        if len(self.prefixes) > PREFIXES:
            self.prefixes.clear()
        last, bytes_of, out = self.prefixes, self.vocabulary.bytes_of, []
        while data:
            t = last[data]
            out.append(t)
            data = data[: -len(bytes_of[t])]
        return tuple(out[::-1])

    def renew(self) -> None:
        self.before = dict(self)
        self.clear()

    def forget(self) -> None:
        """Keep nothing of what was seen."""
        self.clear()
        self.before = {}
        self.prefixes.clear()


class Encoder:
    """Texts to ids and back; of the pieces that were seen, about twice ``KEPT`` are kept at most, and of prefixes about ``PREFIXES``."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.seen = Seen(vocabulary)

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        if self.vocabulary.near and (text.isascii() or not _BEYOND.search(text)):
            return self.vocabulary.near.findall(text)
        if not _LATER.search(text):
            return self.vocabulary.pattern.findall(text)
        shown = _LATER.sub("\\ue000", text)  # neither letter nor number, as the tables of the ranks have it
        return [text[m.start() : m.end()] for m in self.vocabulary.pattern.finditer(shown)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.seen.__getitem__, self.split(text))))

    def forget(self) -> None:
        """Keep the vocabulary alone."""
        self.seen.forget()
        self.vocabulary.forget()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, ids))


class EditableText:
    """A text with the prefix table of each piece; an edit splits and encodes anew only what lies near it."""

    def __init__(self, encoder: Encoder, text: str = ""):
        self.encoder, self.text = encoder, ""
        self.pieces: list[str] = []
        self.tokens: list[tuple[int, ...]] = []
        self.edit(0, 0, text)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> int:
        """Put new in place of characters start to end; returns how many pieces were made anew.

        The pattern looks three characters ahead at most, and from a border on, splitting depends on what follows alone: once a
        border after the edit falls on an old one, the rest stays.
        """
        head, at = 0, 0
        while head < len(self.pieces) and at + len(self.pieces[head]) <= start - 3:
            at += len(self.pieces[head])
            head += 1
        old, shift = {}, len(new) - (end - start)
        place = at
        for k in range(head, len(self.pieces)):
            if place >= end:
                old[place + shift] = k
            place += len(self.pieces[k])
        self.text = self.text[:start] + new + self.text[end:]
        tail, fresh = len(self.pieces), []
        shown = _LATER.sub("\\ue000", self.text[at:])
        for m in self.encoder.vocabulary.pattern.finditer(shown):
            if at + m.start() in old and at + m.start() >= start + len(new):
                tail = old[at + m.start()]
                break
            fresh.append(self.text[at + m.start() : at + m.end()])
        self.pieces[head:tail] = fresh
        self.tokens[head:tail] = [self.encoder.seen[p] for p in fresh]
        return len(fresh)

    def ids(self) -> list[int]:
        return list(chain.from_iterable(self.tokens))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> Encoder:
    """The encoder of a file of ranks (base64 of the bytes, blank, rank), once in each process."""
    with open(path, "rb") as f:
        return Encoder(Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern))


def encode(docs: DataFrame, path: str, pattern: str, carry: list[str], ids: bool = False) -> DataFrame:
    """Columns ``carry`` of docs with n_tokens, ids_sha256 and decoded_sha256 of column text, and the ids themselves if asked for.

    ``path`` is that of an installed vocabulary, which every executor has.
    """
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    carry = others(carry, added)
    names = [*carry, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]

    def run(batches):
        coder = load(path, pattern)
        text_of = coder.vocabulary.text_of.__getitem__
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in batch.column(len(carry)):
                got = coder.encode(text.as_py() or "")
                out[0].append(len(got))
                out[1].append(hashlib.sha256(",".join(map(text_of, got)).encode()).hexdigest())
                out[2].append(hashlib.sha256(coder.decode(got)).hexdigest())
                if ids:
                    out[3].append(got)
            made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), *[pa.array(out[3], pa.list_(pa.int32()))] * ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], names)
        coder.forget()  # the process goes on to other tasks

    return docs.select(*carry, docs["text"].alias("__text")).mapInArrow(run, extended(docs.select(*carry).schema, added))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: ids of every document and the bytes they decode to, as hashes."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
