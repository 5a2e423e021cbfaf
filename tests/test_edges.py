"""Operators on edge rows against plain restatements of their rules."""

import itertools
import random
from html.parser import HTMLParser

import pytest
from newsquant.functions.words import DOMAIN_MARKS
from newsquant.operators import pages, text, topics
from newsquant.sources import readers


def plain_cut(words, phrases, low=3, high=5):
    """``words`` are (term, score) in their own order; the terms that stay."""
    if len(words) < low:
        return (phrases + [w for w, _ in words])[:low]
    down = sorted(words, key=lambda w: (-w[1], w[0]))
    s = [x for _, x in down]
    gaps = [(i, s[i - 1] - s[i]) for i in range(low, min(len(s) - 1, high + 1))]
    at = max(gaps, key=lambda g: g[1])[0] if gaps else low
    at = max(low, min(at, high))
    at = min(at, max(low, next((i for i, x in enumerate(s) if x < 0), len(s))))
    kept = {w for w, _ in down[:at]}
    own = [p for p in phrases if any(m in p for m in DOMAIN_MARKS)]
    return own + [w for w, _ in words if w in kept][: high - len(own)]


def test_cut_and_filter_terms(spark):
    r, want, terms, scores = random.Random(5), {}, [], []
    fixed = [[0.9, 0.85, 0.8, 0.75, 0.1], [0.9, 0.85, 0.8, 0.75, 0.7, 0.1], [0.5, 0.4, 0.3], [0.5, 0.4, -0.1, -0.2], [0.9, 0.8]]
    for topic in range(40):
        values = fixed[topic] if topic < len(fixed) else [round(r.uniform(-0.3, 1), 1) for _ in range(r.randint(1, 8))]
        words = [(f"w{i}", v) for i, v in enumerate(values)]
        phrases = [f"{r.choice(['quantum', 'plain'])} p{i}" for i in range(r.choice([0, 1, 2, 7]))]
        want[topic] = plain_cut(words, phrases)
        listed = (phrases + [w for w, _ in words]) if topic % 2 else phrases + [w for w, _ in words]
        terms += [(topic, rank, t, 1.0) for rank, t in enumerate(listed, 1)]
        scores += [(topic, w, v) for w, v in words]
    out = topics.filter_terms(spark.createDataFrame(terms, "topic_id int, rank int, term string, weight double"), spark.createDataFrame(scores, "topic_id int, term string, score double"))
    got = {}
    for row in sorted(out.collect(), key=lambda x: (x["topic_id"], x["rank"])):
        got.setdefault(row["topic_id"], []).append(row["term"])
    assert got == want


@pytest.mark.parametrize("n, forced", [(4, ["A", "B", "ZZ"]), (2, ["A", "B"]), (1, ["A", "B"]), (50, ["A"]), (3, []), (0, [])])
def test_sample_companies(spark, n, forced):
    tickers = ["A", "B", "B", *"CDEFGH"]
    rows = [r["ticker"] for r in readers.sample_companies(spark.createDataFrame([(t,) for t in tickers], "ticker string"), n, forced).collect()]
    own = [t for t in tickers if t in forced]
    rest = len(tickers) - len(own)
    left = n - len(own)
    assert len(rows) == len(own) + (left if 0 < left < rest else rest)
    assert sorted(t for t in rows if t in forced) == own and set(rows) <= set(tickers)


def test_phrase_blacklists(spark):
    said = "united states army contracts. united states. global beverage group. north america. asia pacific growth."
    out = text.company_keywords(spark.createDataFrame([("T", "Nobody", said)], "ticker string, name string, description string"), 50)
    got = {r["phrase"] for r in out.collect()}
    assert "united states army" in got and "asia pacific growth" in got
    assert not got & {"united states", "north america", "asia pacific"} and not [p for p in got if "beverage" in p]


class Bodies(HTMLParser):
    """Paragraph texts of the article by a stack of open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.texts, self.seen = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in pages.VOID_TAGS:
            return
        given = dict(attrs)
        words = [given.get(c) or "" for c in ("class", "id")]
        gone = tag in pages.BARE_TAGS or any(m in w.lower() for w in words for m in pages.FURNITURE.split("|"))
        kind = [k for k, (where, word) in enumerate(pages.PLACES) if (tag == word if where == "tag" else word in words[where == "id"])]
        self.seen += 1
        self.stack.append((tag, self.seen, gone, kind[0] if kind else None))
        self.texts.append((list(self.stack), ""))

    def handle_endtag(self, tag):
        names = [s[0] for s in self.stack]
        if tag in names:
            del self.stack[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        self.texts.append((list(self.stack), data))


def plain_body(html, low=300):
    parser = Bodies()
    parser.feed(html or "")
    parser.close()
    left = [(s, t) for s, t in parser.texts if not any(x[2] for x in s)]
    found = sorted({(x[3], x[1]) for s, _ in parser.texts for x in s if x[3] is not None and not any(y[2] for y in s[: s.index(x) + 1])})
    if found:
        left = [(s, t) for s, t in left if any(x[1] == found[0][1] for x in s)]
        inside = lambda s: s[[x[1] for x in s].index(found[0][1]) + 1 :]
    else:
        inside = lambda s: s
    parts = {}
    for s, t in left:
        own = [x[1] for x in inside(s) if x[0] == "p"]
        if own:
            parts[own[-1]] = parts.get(own[-1], "") + t.strip()
    body = " ".join(p for _, p in sorted(parts.items()) if len(p) > 40)
    return body[:50_000] if len(body) > low else None


def test_bodies_by_nesting(spark):
    p = lambda t: f"<p>{t} {'long enough words ' * 4}</p>"
    main = "".join(p(f"part {i} <b>bold</b> &amp; <i>x</i>") for i in range(6))
    htmls = [
        f"<nav><div>{p('menu')}</div></nav><article>{main}</article>{p('remark after')}",
        f"<article>{main}</article><div class='comments'>{p('remark')}</div>",
        f"<div class='menu'><div>inner</div>{p('menu')}</div><main>{main}</main>",
        f"<div class=\"menu\"><div><div>x</div></div>{p('menu')}</div><section id=content>{main}<div><div class='x share'><div></div>{p('share')}</div>{p('stays')}</div></section>{p('out')}",
        f"<span class=Social>{p('social')}</span>{main}",
        f"<article><header>{p('head')}</header>{main}<aside><aside></aside>{p('deep')}</aside>{p('end')}</article>",
        f"<div class=post><article>{main}</article>{p('beside')}</div>",
        f"</div></p><article>{main}</div></article>{p('late')}",
        f"<!-- <article>{p('comment')}</article> --><article>{main}</article><script>'<article>'{p('code')}</script>",
        f"<body class='has-Header'>{main}</body>",
        f"<article>{p('short')}</article><article>{main}</article>",
        "", None, "no tags at all", "<", "<p", f"<article data-x='a > b'>{main}</article>",
    ]
    r = random.Random(3)
    atoms = ["<div>", "</div>", "<div class='nav'>", "<section>", "</section>", "<article>", "</article>", '<main id="content">', "</main>", "<br>", "<img class=menu src='x'/>"]
    for _ in range(60):
        blocks = [r.choice(atoms) if r.random() < 0.6 else p(f"t{r.randint(0, 99)}") for _ in range(30)]
        # elements that close in order, as the restatement pops by stack
        stack, out = [], []
        for b in blocks:
            name = b[1:].split(" ")[0].rstrip(">") if b[1] != "/" else b[2:-1]
            if b.startswith("<p") or name in ("br", "img"):
                out.append(b)
            elif b[1] == "/":
                if stack and stack[-1] == name:
                    stack.pop()
                    out.append(b)
            else:
                stack.append(name)
                out.append(b)
        htmls.append("".join(out + [f"</{n}>" for n in reversed(stack)]))
    df = spark.createDataFrame(list(enumerate(htmls)) + [(0, htmls[0])], "page_id long, html string")
    got = sorted((r["page_id"], r["body"]) for r in pages.extract_bodies(df, low=100).collect())
    want = sorted((i, plain_body(h, 100)) for i, h in itertools.chain(enumerate(htmls), [(0, htmls[0])]) if plain_body(h, 100))
    assert got == want and len(got) > 30
