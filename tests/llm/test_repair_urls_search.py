"""Conversation repair, URL filters and ranked search against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from wicketworks.llm import lexical
from wicketworks.llm.conversations import ENTRIES, FAR, align, cheapest, damaged, repair, with_unrepaired
from wicketworks.llm.lexical import rank_documents
from wicketworks.llm.urls import filter_urls, rule_table

SPACE = " \t\n\x0b\x0c\r"


# Conversations ----------------------------------------------------------------


def step(state, letter):
    if letter == "u":
        return "u" if state != "u" else None
    return {("0", "s"): "s", ("u", "a"): "a"}.get((state, letter))


def by_states(turns, entry):
    """Cheapest (cost, audit) to each state, by carrying whole audits through the turns; no alignment, no lengths."""

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit) in list(best.items()):
                for letter in "ua":
                    put(best, step(state, letter), (cost + 3, audit + "I"))
        return best

    def put(best, state, way):
        if state and (state not in best or way < best[state]):
            best[state] = way

    best = inserted({entry: (0, "")})
    for turn in turns:
        after = {}
        for state, (cost, audit) in best.items():
            put(after, state, (cost + 4, audit + "D"))
            if turn != "-":
                stays = cost + 3 * turn.isupper()
                put(after, step(state, turn.lower()), (stays, audit + "K"))
                for letter in "ua":
                    put(after, step(state, letter), (stays + 3, audit + "R"))
        best = inserted(after)
    return best


def test_alignment_is_the_cheapest_and_least():
    rng = random.Random(1)
    for n in range(2500):
        letters = rng.choice(["suaxSUAX-", "uauauaUA-", "a", "uu-"])
        turns = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 14])))
        for entry in ENTRIES:
            best = by_states(turns, entry)
            assert [align(turns, entry, leave) for leave in ENTRIES] == [best.get(leave, (FAR, "")) for leave in ENTRIES], (turns, entry)
    for turns in ("ua" * 150 + "-" * 20 + "AU" * 40, "s" * 60, "S" + "u" * 200):
        best = by_states(turns, "0")
        assert cheapest(turns) == min(best["0"], best["a"])


def repaired_by_hand(rows):
    """rows: (turn, role, text) of one conversation, in order."""
    seen, code, counts = set(), "", Counter()
    for _, role, text in rows:
        said = text.rstrip(SPACE)
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        code += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
    best = by_states(code, "0")
    cost, audit = min(best[s] for s in "0a" if s in best)
    lines, i, state = [], 0, "0"
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        letter = rows[i][1][0] if edit == "K" else "a" if state == "u" else "u"
        role = rows[i][1] if edit == "K" else {"u": "user", "a": "assistant"}[letter]
        lines.append(f"{role}:{'' if edit == 'I' else rows[i][2]}")
        state, i = letter, i + (edit != "I")
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest


def conversations():
    rng = random.Random(4)
    out = []
    for conv in [*range(25), None]:
        for turn in [*range(rng.choice([1, 2, 5, 9])), *([None] if rng.random() < 0.2 else [])]:
            if rng.random() < 0.1:
                continue
            role = rng.choice(["system", "", "tool"]) if rng.random() < 0.15 else ("user", "assistant")[(turn or 0) % 2]
            text = rng.choice([f"Say {rng.random()}.", f"Line\nnumber {turn}", "Same again!", "", " \t\n", "É " * 30 + "?"])
            out.append((conv, turn, role, text))
    out += [(100, t, ("user", "assistant")[t % 2], f"Turn {t}." if t % 7 else "") for t in range(60)]
    out += [(101, 0, "user", "Hello.")] * 4  # repeated rows
    return out


@pytest.mark.parametrize("piece", [512, 3, 1])
def test_repair(llm, piece):
    rows = conversations()
    df = llm.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "conv_id long, turn long, role string, text string, fault string, same int")
    found = {r.conv_id: tuple(r[1:]) for r in repair(df.repartition(3), piece).collect()}
    want = {}
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0))
        want[conv] = repaired_by_hand(own)
    assert found == want
    assert repair(df.where("conv_id < 0"), piece).count() == 0


def test_repair_of_nulls(llm):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, None, None), (1, 0, "user", "Yes."), (1, 1, "assistant", None), (2, None, "user", "No."), (None, None, None, "Odd")]
    found = {r.conv_id: r for r in repair(llm.createDataFrame(rows, schema)).collect()}
    assert (found[1].blank, found[1].illegal, found[1].audit, found[1].cost) == (2, 1, "DKDI", 11)
    assert (found[2].gaps, found[2].audit) == (0, "KI") and (found[None].truncated, found[None].audit) == (1, "D")
    assert found[None].repaired_sha256 == hashlib.sha256(b"").hexdigest()


def test_damage(llm):
    import zlib

    rows = [(c, t, "assistant", f"One. Two! {c}?") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want[c, t, "user" if kind == 4 else role, text] += {0: 0, 3: 2}.get(kind, 1)
    assert Counter(tuple(r) for r in damaged(df).collect()) == +want
    none = with_unrepaired(repair(df.where("conv_id < 0")), df)
    assert none.count() == 41 and none.where("cost = 0 and audit = '' and gaps = 0").count() == 41


# URLs -------------------------------------------------------------------------

URLS = [
    None, "", "no scheme.net/", "http://", "http:///x", "http://a.net", "http://a.net/", "HTTP://A.B.NET/En/x", "https://net?x=/a", "https://net#/", "x://y://z.net/",
    "http://example.net/en/", "http://www.Example.NET/en/1?u=http://org/", "http://example.net/en", "http://badexample.net/en/1", "http://example.com/de/x#y",
    "http://m.example.com/de", "http://example.com/fr/", "ftp://x.org/fr/a/b", "http://org/fr/", "http://x.org/FR/", "http://a.net:80/", "http://u@net/", "http://net./",
    "http://..net/", "http://é.org/fr/ü\nx", "http://" + "a." * 5000 + "net/" + "b/" * 20000, "http://a.b.c.d.e.f/" + "p/" * 9 + "q", "http://q.r/abc", "http://q.r/abd", "http://q.r/ab/c",
]
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
MORE = RULES + [
    ("block", "d.e.f", "/p/p/p/"), ("allow", "c.d.e.f", "/p/p/"), ("block", "b.c.d.e.f", ""), ("allow", "q.r", "/ab"), ("block", "q.r", "/abc"), ("allow", "q.r", "/abc"),
    ("block", "q.r", "/ab/"), ("block", None, "/"), ("block", "", "/"), ("block", "org", None), ("block", "org", "fr"), ("BLOCK", "EXAMPLE.com", "/de"), ("other", "org", "/"),
]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.encode().lower().decode()
    fit = []
    for action, h, p in rules:
        h, action = h and h.lower(), action.lower()
        if h and p is not None and (not p or p[0] == "/") and action in ("allow", "block") and ("." + host).endswith("." + h) and path.startswith(p):
            fit.append((len(h + p), len(h), action, h + p))
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("rules", [RULES, MORE, []], ids=["given", "more", "none"])
@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_urls(llm, conf, rules, broadcast):
    conf(spark__sql__autoBroadcastJoinThreshold=broadcast)
    rows = [(i if i % 5 else None, u, "x", "rule") for i, u in enumerate(URLS)] + [(3, URLS[12], "y", "host")] * 3
    pages = llm.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(3)
    listed = llm.createDataFrame(rules, "action string, host string, path string")
    want = Counter((i, *judged(u, rules)) for i, u, *_ in rows)
    found = filter_urls(pages, listed)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert Counter(tuple(r) for r in found.collect()) == want
    assert filter_urls(pages.where("page_id < 0"), listed).count() == 0


def test_urls_use_built_in_functions_only(llm, conf):
    pages = llm.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = filter_urls(pages, rule_table(llm, RULES))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExistingRDD|CartesianProduct|NestedLoop", plan)
    assert plan.count("Exchange hashpartitioning(id") == 1 and "ReadSchema: struct<page_id:bigint,url:string>" in plan


# Search -----------------------------------------------------------------------

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.encode().lower().decode() for t in WORDS.findall(text or "")]


def ranked(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n, length = sum(bool(c) for _, c in counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            m = n and length and 75 + 25 * c.total() * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 24, 150])
def test_search(llm, docs, corpus, block_bytes):
    rows = [(i, t) for i, t, *_ in corpus] + [(None, corpus[1][1]), (None, None), (7, corpus[7][1])]
    own = docs.select("doc_id", "text", "key").unionByName(llm.createDataFrame([(*r, "x") for r in rows[-3:]], "doc_id long, text string, key string"))
    items = [(i, " ".join((t or "").split()[3 * i : 3 * i + 8])) for i, t, *_ in corpus[:12]] + [(50, None), (51, " .;"), (52, "Zzyzx"), (53, "ab AB aB"), (53, "ab AB aB"), (None, "one\u00a0two ONE")]
    found = rank_documents(own, llm.createDataFrame([(*r, 9) for r in items], "item_id long, text string, score int"), 5, block_bytes=block_bytes)
    assert Counter(tuple(r) for r in found.collect()) == ranked(rows, items, 5)
    assert rank_documents(docs.where("doc_id < 0"), own.selectExpr("doc_id as item_id", "text")).count() == 0
    assert rank_documents(docs, llm.createDataFrame([], "item_id long, text string")).count() == 0


def test_words_of_long_texts(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abZ09é.,- \n\x00`{_[@/:") for _ in range(4000)) + "x" * 300 + " y"
    want = terms(text)
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(lexical, "CHUNK", size)
        assert [w.decode() for run in lexical.words(text.encode()) for w in run] == want
    assert list(lexical.words(None)) == [] and list(lexical.words(b"")) == []
