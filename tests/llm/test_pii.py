import hashlib
import random
import re

from cases import DOCS_SCHEMA, docs

from seqloom.llm import pii


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]


PIECES = ["a", "b_", "@", ".", "1", "25", "+", "-", " ", "(", ")", "4111111111111111", "1.2.3.4", "a@b.c", "+1 555 123 4567", "é", "%", "\n", "٣", "0" * 30]


def test_base(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 25))) for _ in range(20_000)]
    for t in texts:
        assert pii.base_spans(t) == brute(t), t
    for t in ("9" * 200_000, "a" * 200_000 + "@", "+1" * 50_000, "a@" * 50_000, "1." * 50_000, "a1" * 50_000):
        pii.base_spans(t)
        pii.occurrences(t, pii.base_spans(t))
    few = [None, "", *texts[:200]]
    for r in pii.pii_report(spark.createDataFrame(docs(few), DOCS_SCHEMA)).collect():
        b = brute(few[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in b) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % x for x in b).encode()).hexdigest()
        assert set(filter(None, r.spans.split(","))) >= {"%s:%d:%d" % x for x in b}
        assert len(list(filter(None, r.spans.split(",")))) == len(b) + r.n_added


def planted():
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f'some word{i} here token = "{secret(i)}" and more' for i in range(12)]
    texts.append(f'shout TOKEN = "{secret(99).upper()}" loud')
    texts += [f"your code {i}{i}{i}77{i}1 is not private" for i in range(12)]
    texts += [f"mail me at user{i}x@mail.example.com today" for i in range(12)] + ["", "clean text without any"]
    return texts


def test_bootstrapping_finds_unseen(spark):
    texts = planted()
    got = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(docs(texts), DOCS_SCHEMA)).collect()}
    for i in range(13):
        assert [s.split(":")[0] for s in got[i].spans.split(",")] == ["secret"], texts[i]
        _, a, b = got[i].spans.split(":")
        assert re.fullmatch("[0-9a-fA-F]{40}", texts[i][int(a) : int(b)])
    assert all(got[i].spans == "" for i in range(13, 25))
    assert all(got[i].spans == "email:11:%d" % texts[i].index(" today") and got[i].n_added == 0 for i in range(25, 37))


def mixed(rnd):
    """(texts, spans by text): identifiers that no seed rule matches, in the contexts or the forms of those that seeds match."""
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    number = lambda n: "".join(rnd.choices("0123456789", k=n))

    def card(valid):
        while pii.luhn(c := "4" + number(15)) is not valid:
            pass
        return c

    texts, want = [], []

    def put(before, found, after, kind):
        texts.append(f"{before}{found}{after}")
        want.append({(kind, len(before), len(before) + len(found))} if kind else set())

    for _ in range(40):
        put(f"{word()} paid with card ", card(True), f" {word()}", "card")
        put(f"{word()} write to ", f"{word()}{number(2)}@mail.example.com", f" {word()}", "email")
        put(f"{word()} {word()} ", f"+1 ({number(3)}) 555-{number(4)}", f" {word()}", "phone")
    for _ in range(8):
        put(f"{word()} paid with card ", card(False), f" {word()}", "card")
        put(f"{word()} write to ", f"{word()}{number(2)}@localhost", f" {word()}", "email")
        put(f"{word()} {word()} ", f"+1 ({number(3)}) 555-{number(4)}", " 190.137.2.9", "phone")
        want[-1].add(("ip", len(texts[-1]) - 11, len(texts[-1])))
    for _ in range(15):
        put(f"{word()} order {word()} ", card(False), f" {word()} version 2.0.", None)
    return texts, want


def scored(texts):
    """The bootstrapping over one text after the other, in plain Python."""
    extracts, known, places = {}, {}, {}
    for i, t in enumerate(texts):
        for o in pii.occurrences(t, pii.base_spans(t)):
            for p in o["patterns"]:
                extracts.setdefault(p, set()).add(o["instance"])
                if o["free"]:
                    places.setdefault(p, []).append((i, o["start"], o["end"]))
            if o["kind"]:
                known[o["instance"], o["kind"]] = 1.0
    extracts, seeds, accepted = {p: x for p, x in extracts.items() if len(x) >= 5}, dict(known), None
    while True:
        score = {(p, k): min(1.0, sum(known.get((x, k), 0) for x in xs) / len(xs)) for p, xs in extracts.items() for k in pii.KINDS}
        score = {a: round(c, 6) for a, c in score.items() if round(c, 6) >= 0.8}
        if score == accepted:
            break
        accepted, known, doubt = score, dict(seeds), {}
        for (p, k), c in score.items():
            for x in extracts[p]:
                doubt[x, k] = doubt.get((x, k), 1.0) * max(1e-9, 1 - c)
        for a, d in doubt.items():
            known[a] = max(known.get(a, 0), 1 - d)
    out = [{(k, s, e) for k, s, e in pii.base_spans(t)} for t in texts]
    best = {}
    for (p, k), c in accepted.items():
        for place in places.get(p, ()):
            best[place] = max(best.get(place, (0, "")), (c, k))
    merged = []
    for (i, s, e), b in sorted(best.items()):
        if merged and merged[-1][0] == i and s < merged[-1][2]:
            merged[-1] = (i, merged[-1][1], max(e, merged[-1][2]), max(b, merged[-1][3]))
        else:
            merged.append((i, s, e, b))
    for i, s, e, (_, k) in merged:
        out[i].add((k, s, e))
    return out


def test_bootstrapping_finds_what_no_seed_rule_matches(spark):
    texts, want = mixed(random.Random(15))
    got = [set()] * len(texts)
    for r in pii.pii_report(spark.createDataFrame(docs(texts), DOCS_SCHEMA)).collect():
        got[r.doc_id] = {(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)}
        assert r.n_spans == len(got[r.doc_id])
    assert got == scored(texts)
    found, planted = sum(map(len, got)), sum(map(len, want))
    right = sum(len(a & b) for a, b in zip(got, want, strict=True))
    assert right / planted == 1.0 and right / found == 1.0
    assert sum(len(w - {(k, s, e) for k, s, e in pii.base_spans(t)}) for t, w in zip(texts, want, strict=True)) == 24


def test_an_identifier_is_redacted_whole(spark):
    texts, _ = mixed(random.Random(16))
    rows = pii.redact(spark.createDataFrame(docs(texts), DOCS_SCHEMA)).collect()
    assert all("555-" not in r.text and "(" not in r.text for r in rows)
    assert sum("[PHONE] [IP]" in r.text for r in rows) == 8


def test_redact(spark):
    texts = [*planted(), None, planted()[0]]
    ids = [*range(len(texts) - 1), 0]
    d = spark.createDataFrame(docs(texts, ids), DOCS_SCHEMA)
    out = pii.redact(d)
    assert out.schema == d.schema or out.columns == d.columns
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.n_chars == (None if r.text is None else len(r.text))
        assert not re.search("[0-9a-f]{40}|@", r.text or "", re.I)
    assert next(r.text for r in rows if r.doc_id == 0) == 'some word0 here token = "[SECRET]" and more'
    assert pii.redacted("a1b2c3", [(1, 3, "ip"), (2, 4, "card"), (5, 6, "phone")]) == "a[IP]c[PHONE]"
