"""The training-data operators against brute force on small frames and on edge rows."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from newsquant.llm import bpe, classifier, extraction, lattice, lines, packing, quality, sharding, simhash, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()
TEXTS = [
    " ".join(BASE), " ".join(BASE), " ".join(["start", *BASE[2:], "end"]), " ".join(BASE[:14]), None, "", " \n\t ", "one", "a a a a a a a a\nx\na a a a a a a a",
    " ".join(f"w{i}" for i in range(3000)), "Ünï cødé 漢字 \x0b x", "la la " + " ".join(BASE) + " la la",
]
SCHEMA = "doc_id long, text string, lang string, doc int, n int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 1, 2, "k") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "en", 1, 2, "k")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def test_quality_counts(docs, empty):
    got = {r.doc_id: r for r in quality.apply_rules(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = words(t)
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        n = Counter(grams)
        covered = {p for j, g in enumerate(grams) if n[g] > 1 for p in (j, j + 1, j + 2)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
    assert got[8].n_dup_lines == 1
    assert quality.apply_rules(empty).count() == 0


def test_quality_passes_clashing_names_through(spark):
    names = ["doc_id", "text", "_flat", "_words", "__pipes", "_Lines", "n_words", "row"]
    out = quality.apply_rules(spark.createDataFrame([(1, "one two", "f", 2, 3.0, "l", "replaced", "r")], names))
    row = out.first()
    assert [row[c] for c in ("doc_id", "text", "_flat", "_words", "__pipes", "_Lines", "n_words", "row")] == [1, "one two", "f", 2, 3.0, "l", 2, "r"]
    assert not set(out.columns) - {*names, "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"{r}_ratio" for r in ("repeat", "symbol", "pipe", "upper", "stop", "dup_line")), "mean_word_chars", "base_failed", "failed", "kept"}


def test_substrings_equal_brute_force(docs, empty):
    first = {}
    for i, t in enumerate(TEXTS):
        w = words(t)
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    rows = substrings.dedup_substrings(docs).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        w = words(TEXTS[r.doc_id])
        gone = {p for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < r.doc_id for p in range(j, j + 13)}
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert substrings.dedup_substrings(empty).count() == 0


def test_simhash_equals_brute_force(spark, docs, empty):
    prints = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in enumerate(TEXTS)}
    label = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    label[a] = min(label[a], label[b])
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()} == set(label.items())
    assert simhash.simhash_components(empty).count() == 0
    rng = np.random.default_rng(1)
    values = [int(rng.integers(0, 2**62)) for _ in range(40)]
    values = sorted(set(values + [v ^ (1 << i) ^ (1 << (i + 20)) for i, v in enumerate(values)]))
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    for rows in (4000, 1):  # 1: every shard is dealt again
        links = {frozenset((r.a, r.b)) for r in simhash.fingerprint_links(frame, 4, rows).collect()}
        assert links == {frozenset((a, b)) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4}


def test_sharding_moves_only_into_the_new_shard(spark, empty):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.shard_documents(docs, sharding.Topology.uniform(4, 2, 5), buckets=7).collect()
    assert all(r.grown_shard in (r.shard, 40) for r in rows) and any(r.grown_shard == 40 for r in rows)
    for shard in range(40):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and 50 < len(slots) < 160
    assert all(r.text_crc32 == zlib.crc32(str(r.doc_id).encode()) for r in rows)
    assert sharding.shard_documents(empty, sharding.Topology.uniform(2, 2, 2)).count() == 0


def test_packing(docs, empty):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    rows = packing.pack_documents(docs.dropDuplicates(["doc_id"]), path).collect()
    tokenizer = Tokenizer.from_file(path)
    total = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(TEXTS)}
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in total} == total
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        ends = [a + n for a, n in own]
        assert [a for a, _ in own] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert packing.pack_documents(empty, path).count() == 0


def test_packing_ids_equal_the_tokenizer(spark):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    texts = [*TEXTS, "One <|endoftext|> two", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|startoftext|>", "A <|ENDOFTEXT|> <|endoftext| b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc: (r.length, r.ids_crc32) for r in packing.token_pieces(frame, path, room=10**6).collect()}
    tokenizer = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_plan_is_best_fit():
    slots = packing.plan_slots({5: 3, 3: 4, 2: 1}, 8)
    used = Counter()
    for length, a, b, first, each, _ in slots:
        for r in range(a, b):
            used[first + (r - a) // each] += length
    assert sum(used.values()) == 29 and max(used.values()) <= 8 and len(used) == 4


def test_bpe_round_trip(docs, empty):
    vocab = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = vocab.path("byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("t", pat_str=vocab.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.encode_documents(docs, path, vocab.PATTERN, block_bytes=50).collect():
        text = TEXTS[r.doc_id] or ""
        assert r.ids == " ".join(map(str, whole.encode_ordinary(text))) and bytes(r.decoded) == text.encode()
    assert bpe.encode_documents(empty, path, vocab.PATTERN).count() == 0


def test_lines_keep_one_of_alike(spark, empty):
    line = " ".join(f"word{i}" for i in range(30))
    near = line.replace("word29", "other")
    rows = [(1, f"{line}\nshort"), (2, f"x\n{line}"), (3, f"{near}\n{near}"), (4, None), (5, ""), (6, "\n \n\n"), (7, "short\nX"), (None, line)]
    got = {r.doc: r.removed for r in lines.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [1], 3: [0, 1], 7: [0]}
    frame = spark.createDataFrame([(*r, 7, 8, 9, "k") for r in rows], "doc_id long, text string, _doc int, _removed int, id int, line string")
    out = lines.dedup_lines(frame).collect()
    assert {r.doc_id: r.text for r in out} == {1: rows[0][1], 2: "x", 3: "", 4: None, 5: "", 6: "\n \n\n", 7: "X", None: line}
    assert all((r._doc, r._removed, r.id, r.line) == (7, 8, 9, "k") for r in out)
    assert lines.removed_lines(empty).count() == 0


def test_lines_of_repeated_ids_go_where_they_are(spark):
    a, b = ("some line that says enough " * 3).strip(), ("a wholly different text here " * 3).strip()
    frame = spark.createDataFrame([(1, a), (2, f"{b}\n{a}"), (2, f"{b}\nzebra"), (2, f"{b}\n{a}")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in lines.dedup_lines(frame).collect()) == [(1, a), (2, b), (2, b), (2, f"{b}\nzebra")]


def _line_labels(texts, chars=9):
    """The smallest index reachable over links of all pairs, by brute force."""
    sets = [{t[i : i + chars] for i in range(max(1, len(t) - chars + 1))} for t in texts]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(texts), len(number)), dtype=np.float32)
    for i, own in enumerate(sets):
        held[i, [number[s] for s in own]] = 1
    common, n = held @ held.T, held.sum(1)
    links = np.argwhere(common / (n[:, None] + n - common) >= 0.8 - 1e-6)
    label = np.arange(len(texts))
    while True:
        low = label.copy()
        np.minimum.at(low, links[:, 0], label[links[:, 1]])
        if (low == label).all():
            return label
        label = low


def _gone(spark, texts, **how):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc for r in lines.removed_lines(frame, **how).collect()}


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [f"word{i:03d}" for i in range(40)]
    texts = [" ".join(base)]
    for _ in range(250):  # edited copies of one template, and of its copies: chains and rivals for a bucket's head
        w = texts[rng.integers(len(texts))].split()
        for at in rng.integers(0, 40, rng.integers(1, 4)):
            w[at] = f"edit{rng.integers(1000):03d}"
        texts.append(" ".join(w))
    texts += [" ".join(f"other{k}x{i}" for i in range(20)) for k in range(30)]
    assert _gone(spark, texts) == {i for i, low in enumerate(_line_labels(texts)) if low != i}


def test_lines_of_chains_hang_together(spark):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(60):  # neighbours link, ends do not
        w = [f"w{rng.integers(10**6):06d}" for _ in range(40)]
        for _ in range(6):
            texts.append(" ".join(w))
            for at in rng.choice(40, 2, replace=False):
                w[at] = f"e{rng.integers(10**6):06d}"
    want = {i for i, low in enumerate(_line_labels(texts)) if low != i}
    found = _gone(spark, texts)
    assert found <= want and len(found) >= 0.98 * len(want) > 200


def test_lines_compare_a_pair_once_for_both_steps(spark, monkeypatch):
    made = []
    shingles = lines.shingles
    monkeypatch.setattr(lines, "shingles", lambda line, chars: made.append(chars) or shingles(line, chars))
    words = [f"w{i:03d}" for i in range(40)]
    near = [" ".join(["edit", *words[1:]]), " ".join([*words[:39], "last"])]
    texts = [" ".join(words), *near, "Ünï cødé", "漢字 short", "漢字 short", "x"]
    assert _gone(spark, texts) == {i for i, low in enumerate(_line_labels(texts)) if low != i} == {1, 2, 5}
    assert made == [9, 9]


def test_lines_recall_at_the_threshold(spark):
    """Of pairs of which each shingle is shared with chance 0.8 or a little more, nearly all meet in a bucket."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        w = [f"u{rng.integers(10**6):06d}" for _ in range(60)]
        rows.append((2 * k, " ".join(w)))
        for at in rng.choice(60, 3, replace=False):
            w[at] = f"v{rng.integers(10**6):06d}"
        rows.append((2 * k + 1, " ".join(w)))
    frame = spark.createDataFrame([(i, 1, t) for i, t in rows], "id long, n long, line string")
    keys = {r.id: set(r["keys"]) for r in lines.signatures(frame, 9, 8, 4, 3).collect()}
    assert sum(bool(keys[2 * k] & keys[2 * k + 1]) for k in range(300)) >= 0.97 * 300


def test_lattice_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:3]]).astype("f4")
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    unit = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in lattice.embedding_components(frame).collect()}
    assert [got[i].n_links for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert all(got[i].component_id == min(i, *np.flatnonzero(linked[i]).tolist(), i) for i in range(len(x)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in (900, 901, 902, 903))


def test_lattice_recall():
    rng = np.random.default_rng(4)
    a, b = rng.standard_normal((2, 1000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    how = lattice.LatticeHash()
    x, y = how.cells(a), how.cells(b)
    assert ((x[:, :, :1] == y).any(axis=2) | (x == y[:, :, :1]).any(axis=2)).any(axis=1).mean() > 0.97


def test_lattice_border_recall():
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((2, 10000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1, keepdims=True)
    how = lattice.LatticeHash()
    x, y = how.cells(a), how.cells(b)
    assert ((x[:, :, :1] == y).any(axis=2) | (x == y[:, :, :1]).any(axis=2)).any(axis=1).mean() > 0.9995


def test_extraction(spark):
    page = "<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><h1>Head</h1><p>One &amp; two<br>three<p>Four<script>x</script></article><div class='comments'><p>bad</p></div><footer>f</footer>"
    bare = lambda t: f"<body><div>Shared top</div><div>{t} and some more words</div><div>Shared end</div>"
    rows = [(1, "http://a/x", page), (2, "http://b/1", bare("first")), (3, "http://b/2", bare("second")), (4, None, None), (5, "u", "")]
    got = {r.page_id: r.text for r in extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Head\n\nOne & two three\n\nFour", 2: "first and some more words", 3: "second and some more words", 4: "", 5: ""}
    assert extraction.shared_lines(np.array([1, 2, 3, 4]), np.array([1, 3, 9, 4])).tolist() == [0, 2, 3]


def test_extraction_keeps_what_the_article_holds():
    text = lambda page: [t for t, m in extraction.page_blocks(page) if m == extraction.ARTICLE]
    assert text("<article><p>One</p><figure><figcaption>Caption</figcaption></figure><p>x <math><mi>y</mi></math></p></article>") == ["One", "Caption", "x y"]
    assert text("<article><p>One</p><noscript>two</noscript><object>three</object><canvas>four</canvas></article>") == ["One", "twothreefour"]
    assert text("<body><svg/><svg width='1' /><article><p>One</p></article>") == ["One"]
    assert text("<body><svg><article><p>One</p></article>") == ["One"]
    assert text("<body><article><p>One</p><script>let x = 1;") == ["One"]
    assert text("<body><article class='post has-comments'><p>One</p></article>") == ["One"]
    assert text("<body><div class='content with-sidebar'><div class='sidebar'>no</div><article><p>One</p><div class='ad'>no</div></article></div>") == ["One"]


def test_extraction_cuts_templates_inside_articles_only(spark):
    words = "one two three four five six seven eight nine ten " * 3 + "end"
    page = lambda t, head="Same head", more="": f"<body><article><h1>{head}</h1><p>Our paper is printed daily</p><p>{t} {words}</p>{more}</article><div>Rest of {t}</div><div>Shared end</div>"
    quote = "<p>A sentence that two neighbours quote</p>"
    rows = [(i, f"http://a/{i}", page(f"text{i}", more=quote if i in (3, 4, 5) else "")) for i in range(1, 9)]
    rows += [(11, "http://b/1", page("first")), (12, "http://b/2", page("second"))]
    rows += [(21, "http://c/1", page("copy")), (22, "http://c/2", page("copy")), (23, "http://c/3", page("copy")), (31, "http://d/1", page("alone"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in extraction.extract_pages(df).collect()}
    for i in range(1, 9):
        quoted = ["A sentence that two neighbours quote"] if i in (3, 4, 5) else []
        assert got[i] == ["Same head", f"text{i} {words}", *quoted, f"Rest of text{i}"]
    for i, t in ((11, "first"), (12, "second")):  # two pages are no evidence inside an article
        assert got[i] == ["Same head", "Our paper is printed daily", f"{t} {words}", f"Rest of {t}"]
    for i, t in ((21, "copy"), (22, "copy"), (23, "copy"), (31, "alone")):
        assert got[i] == ["Same head", "Our paper is printed daily", f"{t} {words}"]
    # without differencing (every pair a copy) nothing is told from the text
    off = {r.page_id: r.text.split("\n\n") for r in extraction.extract_pages(df, copy_share=-1.0).collect()}
    assert off[1] == ["Same head", "Our paper is printed daily", f"text1 {words}"] and off[11] == got[11][:3]


def test_extraction_loses_no_line_of_the_given_articles(spark):
    """Every given page's article is its heading and one whole document."""
    sf = "/root/testdata/sf0.01"
    flat = lambda t: " ".join((t or "").split())
    texts = {flat(r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()}
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = extraction.op8_extraction(spark, sf).collect()
    assert len(out) == len(pages)
    for row in out:
        blocks = row["text"].split("\n\n")
        assert row["n_chars"] == len(row["text"])
        assert blocks == [t for t, m in extraction.page_blocks(pages[row["page_id"]]) if m in (extraction.ARTICLE, extraction.HEADING)]
        assert flat(" ".join(blocks[1:])) in texts


def test_extraction_of_empty_repeated_and_long_pages(spark):
    kind = "page_id long, url string, html string, text string, key int"
    assert extraction.extract_pages(spark.createDataFrame([], kind)).collect() == []
    long = "<article>" + "".join(f"<p>line {i} of a long page</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "http://a/1", long, "x", 1), (1, "http://a/1", long, "y", 2), (None, None, "<p>plain</p>", "z", 3), (2, "http://a/2", None, "z", 4)]
    got = sorted((r.page_id or 0, len(r.text.split("\n\n")), r.text[-10:]) for r in extraction.extract_pages(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, 1, "plain"), (1, 20_000, " long page"), (1, 20_000, " long page"), (2, 1, "")]


def test_trees_learn_and_empty_texts_score(spark, docs):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(classifier.FEATURES)))
    y = (x[:, 2] + x[:, 5] > 1).astype(float)
    trees = classifier.fit(x[:400], y[:400])
    assert ((trees.score(x[400:]) > 0.5) == (y[400:] > 0.5)).mean() > 0.85
    rows = classifier.score(docs, trees).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in rows)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.score(docs, classifier.train(docs, labels)).collect()} == {0.5}
