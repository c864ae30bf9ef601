"""BPE encoding and decoding by a trie of distinct words."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import per_process, picked
from parley.llm.words import Words, split_at_spaces


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


COPIES = 50_000  # digests of whole texts, by a 128-bit hash, that a task remembers
PART = 10_000  # pieces of a text that are put together at a time
# What may be tried where no longer token ends: one of two symbols.
PAIR = (2,)


class TrieEncoder:
    """Encodings of many words at once.

    The BPE encoding of a prefix ends in exactly one token, and removing it leaves the encoding of a
    shorter prefix. So a trie node needs only its last token: the longest way back to an earlier node
    whose own last token may stand before it. Words are inserted into a trie, states are propagated
    depth first, and a prefix that many words share is worked out once.

    The trie is held as its sorted leaves: going through them in order is going through the trie depth
    first, and what two neighbours share is the path that stays on the stack. A word's last symbol
    carries the end-of-word suffix, so words end in leaves of their own. Pieces, words and answers about pairs
    are remembered in two generations of at most ``most``; the older one goes when the younger is
    full, which changes no result. What is remembered of a word is one string, its ids and its tokens with a
    tab between: no token has one, since bytes stand for themselves only where they are printable.
    """

    def __init__(self, path: str, most: int = 400_000, together: int = 2_000_000):
        self.together = together
        self.words = Words(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        # Tables share the strings of the vocabulary and the pairs of the ranks.
        own = {t: t for t in self.ids}
        pairs = [tuple([own.get(x, x) for x in (m if isinstance(m, list) else m.split(" "))]) for m in model["merges"]]
        del model
        self.ranks = {pair: k for k, pair in enumerate(pairs)}
        self.letters = dict(enumerate(byte_letters()))
        # Only tokens that merging produces from their own symbols can be last tokens.
        self.size: dict[str, int] = {}
        self.made_of: dict[str, tuple[str, str]] = {}
        for token in self.ids:
            parts = self.split(token)
            steps = self.merges(parts)
            if len(parts) - len(steps) == 1:
                self.size[token] = len(parts)
                if steps:
                    self.made_of[token] = pairs[self.ranks[steps[-1]]]
        # How long tokens of three symbols and more are, by the last three, the longest first; apart those that
        # end words.
        self.inner, self.final = self.lengths(False), self.lengths(True)
        # Tokens that end words, by what they are without the suffix.
        self.whole = {"".join(parts)[: -len(self.suffix)]: t for t in self.size if len((parts := self.split(t))[-1]) > 1}
        self.id_text = {t: str(i) for t, i in {**self.ids, **self.words.special}.items()}
        self.most = most
        self.pairs: dict[tuple[str, str], bool] = {}
        # One entry for each token at most.
        self.left_edges, self.right_edges = {}, {}
        # Of words and pieces: their ids and their tokens, each joined by a space, and a tab between.
        self.spelled, self.older_spelled = {}, {}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def lengths(self, final: bool) -> dict[str, tuple[int, ...]]:
        found: dict[str, set[int]] = {}
        for token, n in self.size.items():
            parts = self.split(token)
            ends_word = len(parts[-1]) > 1
            if n > 2 and ends_word == final:
                found.setdefault(parts[-3] + parts[-2] + parts[-1][0], set()).add(n)
        return {end: (*sorted(some, reverse=True), 2) for end, some in found.items()}

    def split(self, token: str) -> list[str]:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return list(token)

    def merges(self, symbols: list[str]) -> list[tuple[str, str]]:
        """The merges of plain BPE: the pair of lowest rank, leftmost first, until none is left."""
        parts, done, none = list(symbols), [], len(self.ranks)
        while len(parts) > 1:
            rank, k = min((self.ranks.get(p, none), k) for k, p in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            done.append((parts[k], parts[k + 1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return done

    def beside(self, a: str, b: str) -> bool:
        """Whether merging the joined symbols of two tokens gives just these two.

        It does unless, at some time, the part of ``a`` at the border and the part of ``b`` there form
        a pair that merges before either is used up by its own token.
        """
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            left, right = self.right_edges.get(a), self.left_edges.get(b)
            if left is None:
                left = self.right_edges[a] = self.edge(a, 1)
            if right is None:
                right = self.left_edges[b] = self.edge(b, 0)
            found = self.pairs[a, b] = self.stay_apart(left, right)
        return found

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts at one edge of a token, from its symbol up, and the rank at which each is used up."""
        parts, rank = [], float("inf")
        while True:
            parts.append((token, rank))
            pair = self.made_of.get(token)
            if pair is None:
                return parts[::-1]
            token, rank = pair[side], self.ranks[pair]

    def stay_apart(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        i = j = 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            rank = self.ranks.get((x, y))
            # On a tie the leftmost pair goes first: the one inside the left token, or the one across.
            if rank is not None and rank < until_x and rank <= until_y:
                return False
            if i == len(left) - 1 and j == len(right) - 1:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def encode_words(self, words: set) -> None:
        """Put the ids and tokens of ``words`` into ``spelled``."""
        size, suffix, id_text, letters = self.size, self.suffix, self.id_text, self.letters
        pairs, beside, inner, final = self.pairs, self.beside, self.inner, self.final
        spelled, whole = self.spelled, self.whole
        leaves, stands_for = [], {}
        for word in words:
            if isinstance(word, tuple):
                spelled[word] = f"{id_text[word[0]]}\t{word[0]}"
            elif word.isascii() and word.isprintable():
                leaves.append(word)  # each byte stands for itself
            else:
                path = word.encode().decode("latin-1").translate(letters)
                leaves.append(path)
                stands_for[path] = word
        leaves.sort()
        # The last token of every prefix on the path.
        last, before = [""], ""
        for path in leaves:
            n, length = 0, len(path)
            shared = min(length, len(last)) - 1
            while n < shared and path[n] == before[n]:
                n += 1
            del last[n + 1 :]
            for end in range(n + 1, length):
                for back in inner.get(path[end - 3 : end], PAIR) if end > 2 else PAIR[: end - 1]:
                    token = path[end - back : end] if back <= end else ""
                    if token not in size:
                        continue
                    if back == end:
                        break
                    found = pairs.get((last[end - back], token))
                    if found or (found is None and beside(last[end - back], token)):
                        break
                else:
                    # Some token is the last one; where no longer one is, it is the symbol alone.
                    token = path[end - 1]
                    if token not in size:
                        raise ValueError(f"the vocabulary has no token for {token!r}")
                last.append(token)
            for back in final.get(path[-3:], PAIR) if length > 2 else PAIR[: length - 1]:
                token = whole.get(path[length - back :] if back <= length else "")
                if token is None:
                    continue
                if back == length:
                    break
                found = pairs.get((last[length - back], token))
                if found or (found is None and beside(last[length - back], token)):
                    break
            else:
                token = whole.get(path[-1])
                if token is None:
                    raise ValueError(f"the vocabulary has no token for {path[-1] + suffix!r}")
            n = length - size[token]
            if n:
                tokens = [token]
                while n:
                    token = last[n]
                    tokens.append(token)
                    n -= size[token]
                tokens.reverse()
                told = f"{' '.join([id_text[t] for t in tokens])}\t{' '.join(tokens)}"
            else:
                told = f"{id_text[token]}\t{token}"
            spelled[stands_for.get(path, path)] = told
            before = path

    def learn(self, pieces: set[str]) -> None:
        """Add pieces (runs without white space) to the memory, their new words through one trie."""
        known, older = self.known, self.older
        for piece in pieces & older.keys():
            known[piece] = older[piece]
        if len(self.spelled) > self.most // 2:
            self.older_spelled, self.spelled = self.spelled, {}
        # Most pieces are one word of plain letters.
        single, several = {}, {}
        for piece in pieces - older.keys():
            if piece.isascii() and piece.isalpha():
                single[piece] = piece if piece.islower() else piece.lower()
            else:
                several[piece] = self.words(piece)
        wanted = set(single.values()).union(*several.values())
        spelled, older_spelled = self.spelled, self.older_spelled
        wanted.difference_update(spelled)
        for word in wanted & older_spelled.keys():
            spelled[word] = older_spelled[word]
        self.encode_words(wanted.difference(older_spelled))
        for piece, word in single.items():
            known[piece] = spelled[word]
        for piece, words in several.items():
            known[piece] = "\t".join(self.joined([spelled[w] for w in words]))

    def joined(self, found: list[str]) -> tuple[str, str]:
        """The ids and the tokens of what is remembered of words or pieces; a piece may have no token at all."""
        parts = "\t".join(found).split("\t")
        return " ".join(filter(None, parts[::2])), " ".join(filter(None, parts[1::2]))

    def encode_texts(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """For each text its ids joined by a space, their number, and the decoded text."""
        # Texts share a trie up to so many characters; a longer text has one of its own.
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars + len(texts[at]) <= self.together):
                group.append(split_at_spaces(texts[at]))
                chars += len(texts[at])
                at += 1
            if len(self.known) > self.most // 2:
                self.older, self.known = self.known, {}
            self.learn(set().union(*group).difference(self.known))
            known = self.known
            for pieces in group:
                # A long text in parts: the strings that are joined are there for one part at a time.
                parts = [self.joined([known[p] for p in pieces[k : k + PART]]) for k in range(0, len(pieces), PART)]
                ids, decoded = (" ".join(filter(None, x)) for x in zip(*parts)) if parts else ("", "")
                yield ids, ids.count(" ") + 1 if ids else 0, decoded


def bpe_roundtrip(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: bool = False,
    most: int = 400_000,
    together: int = 2_000_000,
) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids, decoded``.

    With ``digest`` the SHA-256 of ``ids`` and ``decoded`` come in their place, so that the long
    strings never leave the Python worker. ``most`` bounds what a worker remembers (about 0.2 KB each);
    texts share a trie up to ``together`` characters: fewer take less memory and more time.

    A projection: no shuffle, so a hot key or group of copies costs nothing extra and a lost task is
    simply run again. A null text is an empty one (0 tokens, empty strings); repeated rows give
    repeated rows; a null id stays null; an empty table gives no rows. The vocabulary file must be on every executor.
    """

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("trie", tokenizer_path, most, together), lambda: TrieEncoder(tokenizer_path, most, together))
        told: dict[bytes, tuple] = {}
        for batch in batches:
            # Of a batch in Arrow, so many texts at a time become Python strings.
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                # Copies are encoded once: digests are remembered, long strings for these rows alone.
                if not digest or len(told) > COPIES:
                    told.clear()
                keys = [xxhash.xxh3_128_digest(text.encode()) for text in texts]
                fresh = {key: text for key, text in zip(keys, texts) if key not in told}
                rows = encoder.encode_texts(list(fresh.values()))
                if digest:
                    rows = ((sha(ids), n, sha(decoded)) for ids, n, decoded in rows)
                told.update(zip(fresh, rows, strict=True))
                ids, n_tokens, decoded = zip(*[told[key] for key in keys])
                columns = [part.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *names])

    names = ("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")
    source = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    # Ids travel as text, whatever their type.
    kind = source.schema["doc_id"].dataType
    found = source.withColumn("doc_id", F.col("doc_id").cast("string")).mapInArrow(
        run, f"doc_id string, n_tokens bigint, {names[0]} string, {names[1]} string"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))
