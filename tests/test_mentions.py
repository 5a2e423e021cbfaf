"""Mention counts and checks on planted texts against a plain search of every text."""

import random
import re

from newsquant.functions.words import COMMON_WORDS, SHORT_WORDS
from newsquant.operators import mentions, text

COMPANIES = [("REWH", "Thatin Ononst, Inc."), ("ING", "Ing Group Holdings"), ("BLE", "Ble Corp"), ("AI", "Alpha Intel Ltd"), ("THE", "The Company"), ("A", "Agil Tech"), ("ThTh", "Echo Echo Co"), ("BRK2", "Berk 2nd Way"), ("QX9", "Quix 9 Labs")]
ATOMS = ["rewh", "REWH", "$rewh", "x$rewh", "re wh", "thatin ononst, inc.", "Thatin  Ononst", "thatin ononst, .", "ing", "ING", "(ing)", "ticker: ing", "symbol ing", "$ing", "wing", "ing2", "ble", "BLE", "the", "$ai", "$AI!", "ai",
         "a$ai", "th th", "th th th", "ThTh", "thth", "echo echo echo", "echo echo", "brk2", "BRK2", "brk 2", "berk 2nd way", "stock", "since", "Stock", "ceo", "announced", "shares", "\n", "nasdaq", "llc", "ing's", "agil tech", "agil", "QX9", "qx9",
         "quix 9 labs", "filler words that say nothing at all about anything " * 3, "-", ".", "9", "_ing", "ing_", "bl", "group"]


def variants(ticker, name):
    t, n = ticker.lower(), name.lower()
    bare = re.sub(r"\b(inc\.?|corp\.?|corporation|company|ltd\.?|limited|llc|plc)\b", "", n).strip()
    out = [n] + ([bare] if len(bare) >= 3 else [])
    if len(t) == 1:
        return list(dict.fromkeys(out))
    if len(t) == 2 and t in SHORT_WORDS:
        return [n]
    words = name.split()
    acronym = "".join(w[0] for w in words if re.match("[A-Z]", w) or len(w) > 3).lower()
    out = [t, "$" + t] + out
    if len(words) >= 2 and len(acronym) >= 3 and acronym not in COMMON_WORDS:
        out.append(acronym)
    if len(t) >= 4:
        out += [f"{t[:i]} {t[i:]}" for i in range(2, len(t) - 1)]
    return list(dict.fromkeys(out))


def counted(body, ticker, name):
    total, said = 0, []
    for v in variants(ticker, name):
        if len(v) < 2 or (len(v) == 2 and not v.startswith("$")) or (len(v) <= 3 and v in COMMON_WORDS | SHORT_WORDS):
            continue
        tight = len(v) <= 3 and " " not in v
        pattern = rf"(?<![a-z]){re.escape(v)}(?![a-z])" if tight else rf"\b{re.escape(v)}\b"
        hits = list(re.finditer(pattern, body, re.I))
        if tight and not v.startswith("$"):
            hits = [m for m in hits if stocky(body, v, m)]
        if hits:
            total += len(hits)
            said.append(f"{v} ({len(hits)}x)")
    return total, sorted(said)


def stocky(body, v, m):
    near = body[max(0, m.start() - 50) : m.end() + 50]
    tight = body[max(0, m.start() - 10) : m.end() + 2]
    return any(w in near for w in mentions.STOCK_WORDS) or "$" in body[max(0, m.start() - 5) : m.start()] or bool(re.search(rf"(ticker|symbol|code)[:\s]{re.escape(v)}", tight)) or f"({v})" in tight


def valid(body, ticker, name):
    low, t = body.lower(), ticker.lower()
    hits = list(re.finditer(rf"\b{re.escape(t)}\b", low))
    if len(ticker) <= 4 and ticker.isupper() and not any(c.isdigit() for c in ticker):
        words = [w for w in name.lower().split() if len(w) > 3][:2]
        for m in hits:
            near = low[max(0, m.start() - 100) : m.end() + 100]
            if any(w in near for w in words) or any(re.search(c.replace("T", re.escape(t)), near) for c in mentions.CONTEXTS):
                return True
        return False
    return any(body[m.start() : m.end()].isupper() or body[m.start()].isupper() for m in hits)


def test_mentions_by_plain_search(spark):
    r = random.Random(11)
    bodies = ["".join(r.choice(ATOMS) + r.choice([" ", " ", " ", ", ", "", "\n"]) for _ in range(r.randint(0, 60))) for _ in range(220)]
    bodies += ["x " * 6000 + "ing shares", "ing", "", " ", None, "rewh", "$ai", "ai", "th th"]
    articles = spark.createDataFrame(list(enumerate(bodies)), "article_id long, body string")
    companies = spark.createDataFrame(COMPANIES, "ticker string, name string")
    want, good = {}, {}
    for i, body in enumerate(bodies):
        for ticker, name in COMPANIES:
            n, said = counted(body or "", ticker, name)
            if n:
                want[i, ticker] = (n, said)
                good[i, ticker] = valid(body, ticker, name)
    spelt = text.company_variants(companies).groupBy("ticker").agg({"variant": "collect_list"}).collect()
    assert {x[0]: sorted(x[1]) for x in spelt} == {t: sorted(variants(t, n)) for t, n in COMPANIES}
    found = mentions.count_mentions(articles, companies)
    assert {(x["article_id"], x["ticker"]): (x["mentions"], list(x["mentioned_as"])) for x in found.collect()} == want
    checked = mentions.validate_mentions(found, articles, companies)
    assert {(x["article_id"], x["ticker"]): x["valid"] for x in checked.collect()} == good
    three = [s for _, said in want.values() for s in said if re.match(r"[a-z]{3} \(", s)]
    assert len(three) > 50 and len(set(good.values())) == 2


def test_mentions_of_nothing(spark):
    none = spark.createDataFrame([], "article_id long, body string")
    companies = spark.createDataFrame(COMPANIES, "ticker string, name string")
    assert mentions.count_mentions(none, companies).collect() == []
    assert mentions.count_mentions(spark.createDataFrame([(1, "rewh")], "article_id long, body string"), companies.limit(0)).collect() == []


def test_hits_of_an_article_are_checked_together(spark, monkeypatch):
    """One row an article and one entry a company, whatever the number of hits; contexts count where they lie within reach."""
    asked = []
    pairs = mentions.company_pairs
    monkeypatch.setattr(mentions, "company_pairs", lambda rows: asked.extend(rows.collect()) or pairs(rows))
    far = "x " * 60
    bodies = ["rewh " * 500, f"rewh {far}shares", "REWH\nshares", f"{far}rewh, statedisclosed", "İİ inc.rewh", "thth ThTh", "thth", f"shares {far}rewh {far}rewh's", f"rewh {'.' * 95}reported", f"rewh {'.' * 90}reported",
              "Thatin and" + " " * 70 + "rewh", "$rewh", "$ rewh", f"ltd.a {far}{far}rewh"]
    companies = spark.createDataFrame(COMPANIES + [("NIL", None)], "ticker string, name string")
    articles = spark.createDataFrame(list(enumerate(bodies)) + [(99, "nil"), (100, "nil shares")], "article_id long, body string")
    counted = spark.createDataFrame([(i, t) for i in (*range(len(bodies)), 99, 100) for t in ("REWH", "ThTh", "NIL")], "article_id long, ticker string")
    found = {(r["article_id"], r["ticker"]) for r in mentions.validate_mentions(counted, articles, companies).where("valid").collect()}
    names = {t: n for t, n in COMPANIES}
    assert found == {(i, t) for i, b in enumerate(bodies) for t in ("REWH", "ThTh") if valid(b, t, names[t])} | {(100, "NIL")}
    assert {(3, "REWH"), (4, "REWH"), (5, "ThTh"), (7, "REWH"), (9, "REWH"), (10, "REWH"), (11, "REWH")} <= found and not found & {(0, "REWH"), (1, "REWH"), (2, "REWH"), (6, "ThTh"), (8, "REWH"), (13, "REWH")}
    assert len(asked) == len(bodies) + 2 and all(len(r["asked"]) == 1 for r in asked) and sum(len(a["starts"]) for r in asked for a in r["asked"]) > 500
