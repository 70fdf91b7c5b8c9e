"""Small tables and brute-force versions the tests of cargolume.llm share."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def corpus(seed: int = 3):
    """Documents with exact and near copies, nulls, empty, short, very long and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(8, 80)) for _ in range(40)]
    for base in range(4):
        words = texts[base].split()
        for _ in range(4):
            words = words.copy()
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    texts += [texts[0], texts[0], "", None, " \t\n", "one two", "one two", prose(rng, 20_000), "ÀÉ ß ﬁ Σ 中文 \U0001f600"]
    rows = [(i, t, "en", rng.choice(["a", "b", "c", None]), len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, texts[6], None, None, None)]


def shingle_sets(texts: dict, width: int = 5) -> dict:
    out = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        if w:
            out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))}
    return out


def classes(nodes, links) -> dict:
    """Smallest node of each node's component."""
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}
