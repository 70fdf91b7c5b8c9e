"""Chat formatting, BPE, near-dedup, HTML extraction."""

import collections
import hashlib
import random
import time

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cargolume.llm import blocks, bpe, chat, dedup, html
from cargolume.llm.queries.op1 import TOKENIZER as BYTES
from cargolume.llm.queries.op3 import TOKENIZER as WORDS

from .helpers import DOCUMENTS, WORD, classes, corpus, shingle_sets


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(corpus(), DOCUMENTS)


def test_bpe_equals_the_library():
    rng, library, ours = random.Random(5), Tokenizer.from_file(WORDS), bpe.Bpe(WORDS)
    letters = "abcdefghijklmnop'sSΣςİéé\x1c\x1f\x85\xa0​ \t\n0123٣中\U0001f600!?.<|endoftext|>ẞ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "<|endoftext|> x<|startoftext|>Y", "the" * 3000, "a" * 5000, "ab" * 2000 + "<|endoftext|>"]
    for text, ids in zip(texts, ours.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(memoryview(ids).cast("I")) == want, text
        assert ours.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark, documents):
    clash = documents.selectExpr("*", "1 as n_tokens", "'x' as `a.b`")
    rows = bpe.encode_documents(clash, WORDS).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert r["n_tokens"] == len(r["token_ids"]) // 4 and r["a.b"] == "x"
        assert bool(r["decoded_text"]) == bool(WORD.search(r["text"] or ""))
    assert bpe.encode_documents(documents.limit(0), WORDS).count() == 0


CHAT = "conv_id bigint, turn bigint, role string, text string, extra int"
HARD = ["</s>[INST] ok [/INST]", "<\\s>", "<s><\\\\/s>", "[INST]", "<|end|><\\|end|>", "", None, "\\", "x" * 50_000]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], HARD[(c * 3 + t) % len(HARD)], 1) for c in range(9) for t in range(7)]
    rows += [rows[3], (None, None, None, None, None), (None, 1, "assistant", "a", None)]
    frame = spark.createDataFrame(rows, CHAT)
    formatted = chat.format_conversations(frame, BYTES, public_tokenizers.PATTERN)
    got = {r["conv_id"]: r for r in chat.read_back(formatted, BYTES, public_tokenizers.PATTERN).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(frame.limit(0), BYTES, public_tokenizers.PATTERN).count() == 0


def test_control_strings_never_become_reserved_ids():
    mould = chat.template(BYTES, public_tokenizers.PATTERN)
    for text in filter(None, HARD):
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
        assert max(memoryview(mould.encode([text])[0]).cast("I")) < mould.first


def test_dart_signatures_estimate_weighted_jaccard():
    import numpy as np

    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, 300, dtype=np.uint64)
    one, two = rng.uniform(0.2, 4, 300), rng.uniform(0.2, 4, 300)
    two[:150] = one[:150]
    k = 2048
    best = dedup.dart_signatures(np.repeat([0, 1], 300), np.tile(codes, 2), np.concatenate([one, two]), 2, k)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((best[0] == best[1]).mean() - want) < 4 * (want * (1 - want) / k) ** 0.5


def test_near_duplicates_equal_brute_force(spark, documents):
    rows = corpus()
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    sets = shingle_sets(texts)
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = classes(texts, links)
    got = dedup.near_duplicates(documents.withColumnRenamed("lang", "key")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["class_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
    assert len(set(want.values())) <= len(want) - 8
    assert dedup.near_duplicates(documents.limit(0)).count() == 0


def test_shingles_of_blocks_equal_sets():
    texts = [r[1] for r in corpus()]
    sets = shingle_sets(dict(enumerate(texts)))
    sizes = []
    for data, cuts in blocks.blocks(pa.array(texts)):
        owner, codes, counts = blocks.shingles(data, cuts, 5)
        sizes += [int((owner == i).sum()) for i in range(len(cuts) - 1)]
    assert sizes == [len(sets.get(i, ())) for i in range(len(texts))]


PAGES = "page_id bigint, url string, html string, host int"
ARTICLE = "<article><h1>T{0} &amp; x</h1><p>Body  {0}\n a<br>b<p>quoted everywhere<ul><li>i{0}<li>j</ul></article>"


def test_markup_and_templates(spark):
    rows = []
    for n in range(12):
        soup = f"<div><div>Welcome to the site</div><div>text {n} of page</div><p>last {n}</p><div>All rights</div></div>"
        rows.append((n, f"http://soup.example/{n}", soup, 1))
        rows.append((100 + n, f"https://u@Art.example:80/{n}", f"<nav>menu</nav><script>var a='</p>'</script>{ARTICLE.format(n)}<div class='ad'>buy</div><footer>f", 1))
    copies = [(200 + n, "http://art.example/same", f"<p>nav {n % 3}</p>{ARTICLE.format(0)}", 1) for n in range(20)]
    odd = [(300, None, "<div>Welcome to the site</div>", 1), (301, "", None, 1), (302, "x", "", 1), (303, "http://soup.example/1", "<p>a" + "b" * 100_000, 1), rows[0]]
    frame = spark.createDataFrame(rows + copies + odd, PAGES)
    got = html.main_text(frame).collect()
    assert len(got) == len(rows + copies + odd)
    text = {r["page_id"]: r["main_text"] for r in got}
    for n in range(12):
        assert text[n] == f"text {n} of page\nlast {n}"
        assert text[100 + n] == f"T{n} & x\nBody {n} a b\nquoted everywhere\ni{n}\nj"
    assert text[200] == "nav 0\n" + text[100]  # unnamed, and on one page of different text only
    assert (text[300], text[301], text[302], len(text[303])) == ("Welcome to the site", "", "", 100_001)
    assert html.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a <a href='x>y'>l</a>b<span id=ad-1>k<p>z", ["a lb", "z"]),
        ("<main><p>x</p><section class=comments><p>no</p></section></main><aside>k</aside>", ["x"]),
        ("plain &lt; text", ["plain < text"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("</p></div>x<!-- c", ["x"]),
        ("foo <span class=ad>x</span> bar<div class='site-nav'>n</div>", ["foo bar"]),
        ("<article><p>a</p></article><div><p>second half</p></div>", ["a", "second half"]),
        (
            '<article><h2 id="social-history">Social history</h2><p>Body</p><section id="search"><p>Search is old.</p></section></article>',
            ["Social history", "Body", "Search is old."],
        ),
    ],
)
def test_page(source, want):
    blocks, subtrees, _ = html.Page(source).result()
    assert html.kept(blocks, subtrees, set()) == want


@pytest.mark.parametrize("source", ["<a " * 300_000, "<div>x" * 100_000, "<b>" * 50_000 + "<hr>" * 50_000, "<div>" * 50_000 + "</i>" * 50_000, "<!" * 200_000])
def test_broken_and_deep_pages_take_linear_time(source):
    took = []
    for part in (source[: len(source) // 8], source):
        begin = time.perf_counter()
        html.Page(part).result()
        took.append(time.perf_counter() - begin)
    assert took[1] < 24 * took[0] + 0.5  # eight times the page; a quadratic parser takes 64 times as long


def nested(rng, depth=0):
    """A random tree as (tag, children or text)."""
    if depth > 3 or rng.random() < 0.3:
        return ("p", f"t{rng.randrange(12)}")
    return ("div", [nested(rng, depth + 1) for _ in range(rng.randrange(1, 4))])


def source_of(tree):
    tag, content = tree
    return f"<{tag}>{content if isinstance(content, str) else ''.join(map(source_of, content))}</{tag}>"


def trees_in(tree):
    yield tree_key(tree)
    if not isinstance(tree[1], str):
        for child in tree[1]:
            yield from trees_in(child)


def tree_key(tree):
    return source_of(tree)


def left(tree, gone):
    if tree_key(tree) in gone:
        return []
    return [tree[1]] if isinstance(tree[1], str) else [t for child in tree[1] for t in left(child, gone)]


def text_of(tree):
    return left(tree, set())


def test_templates_equal_brute_force(spark):
    rng = random.Random(5)
    pages = [(n, f"http://h{rng.randrange(3)}.example/{n}", nested(rng)) for n in range(150)]
    frame = spark.createDataFrame([(n, url, source_of(t), 1) for n, url, t in pages], PAGES)
    got = {r["page_id"]: r["main_text"] for r in html.main_text(frame).collect()}
    removed = 0
    for n, url, tree in pages:
        host = url.split("/")[2]
        site = {tuple(text_of(t)): t for _, u, t in pages if u.split("/")[2] == host}
        # pages of equal text count once, yet each of their subtrees counts
        on = collections.Counter()
        for texts in site:
            own = {k for _, u, t in pages if u.split("/")[2] == host and tuple(text_of(t)) == texts for k in trees_in(t)}
            on.update(own)
        gone = {k for k, c in on.items() if c >= html.LEAST_PAGES and c >= html.LEAST_SHARE * len(site)}
        want = left(tree, gone)
        removed += len(text_of(tree)) - len(want)
        assert got[n] == "\n".join(want)
    assert removed > 100


def test_pages_keep_clashing_columns(spark):
    frame = spark.createDataFrame([("http://a.example/", "<p>x", 1, 2, 3)], "url string, html string, host int, page int, templates int")
    assert html.main_text(frame).first().asDict() == {"url": "http://a.example/", "host": 1, "page": 2, "templates": 3, "main_text": "x"}
