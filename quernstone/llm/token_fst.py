"""Token counts by a compiled finite-state tokenizer.

The BPE vocabulary of a sentencepiece model is compiled into a deterministic transducer over characters.
A state holds, for the positions that a later token can still reach, the token that ends there; the arc
of a character leads to the next state and carries the change of the token count. For BPE there is exactly one token that can end
a prefix, namely the one that forms a stable pair with the token that ended before it (Berglund and
van der Merwe, 2023), so the automaton is deterministic. States are made when first reached and the
store has a bound, as lazy automata in regular-expression engines have.

No piece of such a vocabulary has a space sign after another character, and a line feed is in no
longer piece; at these places every state goes to the start state. A chunk of text therefore maps all
incoming states to one outgoing state once it holds a boundary: its map is (head, count, tail). The
maps of chunks are composed along a tree, as in the first half of a parallel prefix scan, whose last value is all that is wanted; composition is
associative, so a text can be cut anywhere, and no more than one map a level of the tree is held. If a vocabulary breaks these rules, the whole text is one unit and still counted rightly.

Defined cases: null and empty texts have no tokens; repeated rows, ties and further columns do not
matter; very long texts are cut into chunks and long unbroken words take linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CHUNK_CHARS = 1 << 16
MAX_STATES, MAX_WORDS, MAX_PAIRS = 300_000, 200_000, 400_000


class State:
    """chars, ends, rel: of the last positions, the characters, the tokens that end there, and the counts relative to the current one."""

    __slots__ = ("arcs", "chars", "ends", "rel")

    def __init__(self, chars: str, ends: tuple, rel: tuple):
        self.chars, self.ends, self.rel, self.arcs = chars, ends, rel, {}


class WordCounts(dict):
    """Arcs of whole words from the start state back to it: word -> tokens emitted."""

    def __init__(self, run):
        super().__init__()
        self.run = run

    def __missing__(self, word: str) -> int:
        n = self.run(word)
        if len(word) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[word] = n
        return n


class Transducer:
    def __init__(self, scores: dict[str, float], byte_fallback: bool = True):
        self.scores, self.fallback = scores, byte_fallback
        self.reach = max(map(len, scores), default=1)
        self.begun = {p[:i] for p in scores for i in range(1, len(p))}
        long = [p for p in scores if len(p) > 1]
        cut = not any(SPACE in p.lstrip(SPACE) for p in long) and not any("\n" in p for p in long)
        self.unit = re.compile(r" +[^ \n]*|[^ \n]+|\n" if cut else r"(?s).+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words = WordCounts(self.run)
        self.reset()

    def reset(self) -> None:
        self.start, self.states = State("", (), ()), {}

    def merge(self, text: str) -> list[str]:
        """Plain BPE, used to compile arcs: the best-scored neighbours merge first, then the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], -float("inf")), -i))
            if parts[best] + parts[best + 1] not in self.scores:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def stable(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart and whole; with an empty left one, whether the right one is whole."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def cost(self, token: str) -> int:
        return 1 if token in self.scores or not self.fallback else sum(len(c.encode("utf-8", "surrogatepass")) for c in token)

    def step(self, state: State, char: str) -> tuple[State, int]:
        """Compile the arc of a character."""
        chars, n = state.chars + char, len(state.chars) + 1
        for size in range(min(self.reach, n), 0, -1):
            token = chars[n - size :]
            if size > 1 and token not in self.scores:
                continue
            if size < n and self.stable(state.ends[n - size - 1], token):
                delta = state.rel[n - size - 1] + self.cost(token)
                break
            # The token is all of the unit so far. The first character's token is that character.
            if size == n and self.stable("", token):
                delta = self.cost(token) + (state.rel[0] - self.cost(state.ends[0]) if state.rel else 0)
                break
        else:
            raise ValueError(f"no token can end {chars!r}")
        # Later tokens can only start where the rest of the view begins some piece; what lies before that, but for one end, is dropped.
        keep = next((i for i in range(max(0, n - self.reach), n) if chars[i:] in self.begun), n)
        keep = max(0, keep - 1)
        key = (chars[keep:], (*state.ends, token)[keep:], (*(x - delta for x in state.rel), 0)[keep:])
        made = self.states.get(key)
        if made is None:
            if len(self.states) >= MAX_STATES:
                self.reset()
            made = self.states[key] = State(*key)
        return made, delta

    def run(self, unit: str) -> int:
        state, total = self.start, 0
        for char in unit.replace(" ", SPACE):
            arc = state.arcs.get(char)
            if arc is None:
                arc = state.arcs[char] = self.step(state, char)
            state = arc[0]
            total += arc[1]
        return total

    def count(self, text: str | None, chunk: int = CHUNK_CHARS) -> int:
        """Tokens of a text: the maps of its chunks, composed, applied to the start state."""
        if not text:
            return 0
        text = " " + (text.replace(SPACE, " ") if SPACE in text else text)
        if len(text) <= chunk:
            return sum(map(self.words.__getitem__, self.unit.findall(text)))
        head, count, tail = scanned((self.mapped(text[i : i + chunk]) for i in range(0, len(text), chunk)), self.compose)
        return count + (self.words[head] if head else 0) + (self.words[tail] if tail else 0)

    def mapped(self, chunk: str) -> tuple[str, int, str | None]:
        """State map of a chunk: what is open at its start, the tokens between, what is open at its end (None: it has no boundary)."""
        units = self.unit.findall(chunk)
        return (units[0], sum(map(self.words.__getitem__, units[1:-1])), units[-1]) if len(units) > 1 else (chunk, 0, None)

    def compose(self, a: tuple, b: tuple) -> tuple:
        (head, n, tail), (then, m, end) = a, b
        units = self.unit.findall((head if tail is None else tail) + then)
        lead = [units.pop(0)] if tail is None else []
        last = [units.pop()] if end is None and units else []
        n += m + sum(map(self.words.__getitem__, units))
        return (lead[0] if lead else head, n, end if end is not None else last[0] if last else None)


def scanned(items, compose):
    """The composition of all items, in order, along a balanced tree: neighbours of equal height are composed as soon as both are there."""
    stack: list = []  # (height, map)
    for x in items:
        height = 0
        while stack and stack[-1][0] == height:
            x, height = compose(stack.pop()[1], x), height + 1
        stack.append((height, x))
    last = stack.pop()[1]
    while stack:
        last = compose(stack.pop()[1], last)
    return last


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The transducer of a model file, once per worker process."""
    if path not in _compiled:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        _compiled[path] = Transducer({model.id_to_piece(i): model.get_score(i) for i in ids}, any(model.is_byte(i) for i in range(model.get_piece_size())))
    return _compiled[path]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit. One pass, no shuffle."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = compiled(model_path).count
        for texts in batches:
            yield pd.Series([run(t) for t in texts], dtype="int64")

    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.withColumn("n_bytes", F.octet_length(body).cast("long")).withColumn("n_tokens", tokens(body))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
