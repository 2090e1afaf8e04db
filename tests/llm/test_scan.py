"""PII surrogates and licence scan."""

import hashlib
import re
import textwrap

import pytest
import regex
from pyspark.sql import functions as F

from varietas.llm import licenses, pii, queries_scan

SMALL = "/root/testdata/sf0.001"


# ---- PII ---------------------------------------------------------------------------------------------------

TEXTS = [
    "Mail anna.k-1@mail7.example.com or ANNA.K-1@MAIL7.EXAMPLE.COM or bob@mail7.example.com.",
    "Call +1 (487) 555-7209, (487) 555-7209 or 487-555-7209; not (488) 555-7209.",
    "Card 4111 1111 1111 1111 and 4111111111111111, no card 9807915762804490.",
    "Host 152.143.123.131### and 10.0.0.1, version 1.2.3.4.5 and 4.0. stay",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"',
    "Mr. John Smith met Mrs Mary Smith. Smith left; John stayed. JOHN is not seen.",
    "Госпожа Мария Иванова и Господин Иван Петров.",
    "IBAN DE89 3704 0044 0532 0130 00 is DE89370400440532013000, SSN 123-45-6789.",
    "No person here, only 12 apples and the year 2024.", "", None,
]


def run(spark, texts=TEXTS, key="k1", **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in pii.replace_pii(docs, key).collect()}


def test_surrogates_keep_type_format_and_coreference(spark):
    got = run(spark)
    t = {k: r["text"] for k, r in got.items()}
    m = re.fullmatch(r"Mail (([a-z]{4})\.[a-z]-\d@[a-z]+\.example) or ([A-Z]{4}\.[A-Z]-\d@[A-Z]+\.EXAMPLE) or ([a-z]{3}@([a-z]+)\.example)\.", t[0])
    assert m and m[1].upper() == m[3] and m[1].split("@")[1] == m[4].split("@")[1] and "anna" not in t[0].lower()
    m = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}), \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}); not \((\d{3})\) (\d{3})-(\d{4})\.", t[1])
    assert m and m.groups()[:3] == m.groups()[3:6] == m.groups()[6:9] != m.groups()[9:12] and "7209" not in t[1]
    m = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16}), no card (\d{16})\.", t[2])
    luhn = lambda s: sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(s)) % 10 == 0
    assert m and m[1].replace(" ", "") == m[2] != "4111111111111111" and luhn(m[2])
    m = re.fullmatch(r"Host (\d+)\.\d+\.\d+\.\d+### and (\d+)\.\d+\.\d+\.\d+, version 1\.2\.3\.4\.5 and 4\.0\. stay", t[3])
    assert m and int(m[1]) >= 240 and int(m[2]) >= 240
    m = re.fullmatch(r'token = "([0-9a-f]{40})" TOKEN = "([0-9A-F]{40})"', t[4])
    assert m and m[1].upper() == m[2] and not m[1].startswith("24be6")
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) (\w+)\. (\w+) left; (\w+) stayed\. JOHN is not seen\.", t[5])
    assert m and m[2] == m[4] == m[5] and m[1] == m[6] and m[1] != m[3] and m[1].endswith("o") and m[3].endswith("a")
    assert not re.search("Smith|John|Mary", t[5])
    m = re.fullmatch(r"Госпожа ([А-Яа-я]+а) ([А-Яа-я]+ова) и Господин ([А-Яа-я]+н) ([А-Яа-я]+ов)\.", t[6])
    assert m and not re.search("Мария|Иван|Петров", t[6])
    m = re.fullmatch(r"IBAN (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) is (DE\d{20}), SSN (9\d\d-\d\d-\d{4})\.", t[7])
    assert m and m[1].replace(" ", "") == m[2] != "DE89370400440532013000"
    assert t[8] == TEXTS[8] and t[9] == "" and t[10] is None
    assert [got[i]["n_mentions"] for i in range(11)] == [3, 4, 3, 2, 2, 2, 2, 3, 0, 0, 0]
    assert run(spark, key="k1")[0]["text"] == t[0] != run(spark, key="k2")[0]["text"]


def test_collisions_are_resolved(spark, monkeypatch):
    # many one-letter addresses of one domain share few surrogates
    texts = [f"{c}@x.org" for c in "abcdefghijklmnopqrstuvwxyz"] * 2
    out = [r["text"] for r in run(spark, texts).values()]
    assert len(set(out)) == 26 and out[:26] == out[26:]
    ents = spark.createDataFrame([("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"], "kind string, normal string")
    late = pii.later_attempts(ents, "k1").collect()
    assert late and len({r["normal"] for r in late}) == len(late)


def test_surrogate_is_no_real_entity(spark):
    first = run(spark, ["token = \"abcdefabcdef0123456789\""])[0]["text"]
    value = first.split('"')[1]
    both = run(spark, ["token = \"abcdefabcdef0123456789\"", f'token = "{value}"'])
    assert value not in both[0]["text"] and value not in both[1]["text"]


def test_edge_cases_and_clean_documents(spark):
    docs = spark.createDataFrame([(1, "a@b.cc " * 3000, "x", "y"), (1, "a@b.cc " * 3000, "x", "y"), (None, "1.2.3.4", None, None)],
                                 "doc_id long, text string, n_mentions string, kind string")
    got = pii.replace_pii(docs, "k")
    assert got.columns == [*docs.columns, "n_mentions_", "pii_kinds"]
    rows = got.collect()
    assert len(rows) == 3 and rows[0] == rows[1] and {r["n_mentions_"] for r in rows} == {3000, 1}
    assert pii.replace_pii(docs.limit(0), "k").count() == 0
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = re.compile(r"\S+@\S+|(?:\d{1,3}\.){3}\d|\d{12}|\d{3}-\d{4}|token", re.I)
    for r in queries_scan.op1_pii_surrogates(spark, SMALL).collect():
        old = before[r["doc_id"]]
        assert (r["text"] == old) == (r["n_mentions"] == 0) == (not found.search(old))
        for x in re.findall(r"[\w.]+@[\w.]+\w|\d{16}|(?:\d{1,3}\.){3}\d{1,3}|[0-9a-f]{40}", old):
            assert x not in r["text"]


def test_hint_passes_every_pattern_alone(spark):
    alone = {"email": "a@b.cc", "secret": "password: correcthorsebattery", "iban": "DE89370400440532013000", "hex": "abcdef" * 6,
             "ip": "10.0.0.1", "card": "4111111111111111", "ssn": "123-45-6789", "phone": "487-555-7209", "person": "Mr. Smith"}
    assert set(alone) == set(pii.PATTERNS)
    more = ["api_key=AbCdEfGhIjKlMnOp", '{"token": "AbCdEfGhIjKlMnOp"}', r'{\"secret\":\"AbCdEfGhIjKlMnOp\"}', "PASSWD  =\t 'AbCdEfGhIjKlMnOp'",
            "Api-Key:AbCdEfGhIjKlMnOp"]
    texts = [*alone.values(), *more]
    got = run(spark, texts)
    assert [got[i]["n_mentions"] for i in range(len(texts))] == [1] * len(texts)
    assert not any(x in got[i]["text"] for i in range(len(texts)) for x in ("AbCdEfGhIjKlMnOp", "correcthorsebattery", "abcdef" * 6))
    assert run(spark, ["the token was secret, a password forgotten"])[0]["n_mentions"] == 0


def test_secrets_and_ibans_are_replaced_whole(spark):
    import random
    rng, chars = random.Random(4), "abcdefghijkmnopqrstuvwxyzABCDEFGHIJKLMNPQRSTUVWXYZ0123456789"
    key = lambda n, c=chars: "".join(rng.choice(c) for _ in range(n))
    long, jwt, digits = key(300), ".".join(["eyJhbGciOiJIUzI1NiJ9", key(120), key(43)]), key(300, "0123456789abcdef")
    texts = [f"api_key={long} end", f'{{"token": "{jwt}"}}. Next', f"sum {digits} end", "to NO93 8601 1117 947, or NO9386011117947.",
             f"password: {key(5)}.{key(20)}.", "token: hello......... there"]
    got = run(spark, texts)
    assert [got[i]["n_mentions"] for i in range(6)] == [1, 1, 1, 2, 1, 0]
    assert [got[i]["pii_kinds"] for i in range(6)] == [["secret"], ["secret"], ["secret"], ["iban"], ["secret"], []]
    for t, whole, i in ((long, r"api_key=([A-Za-z0-9]{300}) end", 0), (jwt, r'\{"token": "([\w-]{20}\.\w{120}\.\w{43})"\}\. Next', 1),
                        (digits, r"sum ([0-9a-f]{300}) end", 2)):
        new = re.fullmatch(whole, got[i]["text"])[1]
        assert all(t[k:k + 12] != new[k:k + 12] for k in range(0, len(t) - 12))
    m = re.fullmatch(r"to (NO\d\d \d{4} \d{4} \d{3}), or (NO\d{13})\.", got[3]["text"])
    assert m and m[1].replace(" ", "") == m[2] != "NO9386011117947"
    assert re.fullmatch(r"password: \w{5}\.\w{20}\.", got[4]["text"]) and got[4]["text"] != texts[4] and got[5]["text"] == texts[5]


# ---- licences ----------------------------------------------------------------------------------------------

def plain_form(text):
    """The normal form by another engine, word by word."""
    t = regex.sub(licenses._COPYRIGHT.replace(r"\z", r"\Z"), " ", text or "")
    words = regex.findall(r"[\p{L}\p{N}]+", t.lower())
    for a, b in licenses.SPELLINGS:
        a, b, out, i = a.split(), b.split(), [], 0
        while i < len(words):
            hit = words[i:i + len(a)] == a
            out += b if hit else words[i:i + 1]
            i += len(a) if hit else 1
        words = out
    return " ".join(words)


def test_licence_query_equals_brute_force(spark):
    known = {}
    for r in licenses.standard_licences(spark).collect():
        known.setdefault(plain_form(r["text"]), set()).add(r["name"])
    for name, text in licenses.KNOWN:
        known.setdefault(plain_form(text), set()).add(name)
    said = lambda t: " or ".join(sorted(known.get(plain_form(t), ()))) or None
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries_scan.op5_license_scan(spark, SMALL).collect()
    assert len(got) == len(docs) and any(r["n_license_lines"] for r in got)
    for r in got:
        text = docs[r["doc_id"]] or ""
        form = plain_form(text)
        lines = [said(x) for x in set(text.split("\n")) if plain_form(x) in known]
        assert r["text_digest"] == (hashlib.sha256(form.encode()).hexdigest() if form else None)
        assert (r["whole_license"], r["line_licenses"], r["n_license_lines"]) == (said(text) if form else None, ",".join(sorted(set(lines))), len(lines))


def test_neighbouring_spellings_are_all_replaced(spark):
    a, b = licenses.SPELLINGS[0]
    df = spark.createDataFrame([(f"{a} {a} {a}, x {a}",)], "t string")
    assert df.select(licenses.canonical(F.col("t"))).first()[0] == f"{b} {b} {b} x {b}"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_licence_normal_form_and_edge_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(licenses, "BROADCAST_DIGESTS", limit)
    mit = licenses.MIT
    typeset = "MIT-less header\n".replace("MIT-less header\n", "Copyright (c) 2020 Jane Roe\n(C) 2021 Others. All rights reserved.\n\n")
    texts = [mit, typeset + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace('"', "“"), mit + " extra",
             "prose\nReleased under the  mit licence\nmore\nReleased under the MIT License.", None, "", "Copyright 2020 X"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(3, texts[3], "c")], "doc_id long, text string, name string")
    got = {}
    for r in licenses.scan(docs, licenses.known_licences(spark)).collect():
        got.setdefault(r["id"], []).append(r)
    assert [got[i][0]["whole_license"] for i in range(7)] == ["MIT", "MIT", None, None, None, None, None]
    assert len(got[3]) == 2 and got[3][0] == got[3][1]
    assert got[3][0]["line_licenses"] == ["MIT"] and got[3][0]["n_license_lines"] == 2
    assert [got[i][0]["text_digest"] for i in (4, 5, 6)] == [None] * 3
    two = spark.createDataFrame([("A", "x y"), ("B", "X, Y!"), (None, "z"), ("C", None)], "name string, text string")
    assert [r["name"] for r in licenses.known_digests(two).collect()] == ["A or B"]
    assert licenses.scan(docs, two.limit(0)).where("whole_license IS NOT NULL").count() == 0
    assert licenses.scan(docs.limit(0), two).count() == 0


def reset(text, width):
    """The text with every paragraph on one line (width 0) or wrapped anew."""
    paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
    return "\n\n".join("\n".join(textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)) if width else p for p in paragraphs)


def test_licences_match_however_they_are_wrapped(spark):
    texts, want = [], []
    for name, text in licenses.KNOWN:
        for width in (0, 40, 57, 66, 72, 79, 100, 120):
            texts.append(reset(text, width))
            want.append(name)
        texts.append("Copyright (c) 2020 Jane Roe " + " ".join(text.split()))
        want.append(name)
    changed = licenses.MIT.replace("COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "COPYRIGHT HOLDERS BE LIABLE FOR NO CLAIM")
    lost = "\n".join(x for x in licenses.MIT.split("\n") if not x.startswith("COPYRIGHT"))
    notices = ["Copyright 2020 X", "Copyright (c) Jane Roe", "(c) 2019-2021 X, Y", "© Jane Roe", "# Copyright The Foo Authors.",
               "Copyright Jane Roe <jane@x.org>", "All rights reserved.", "  * All Rights Reserved. Copyright 2001 by X\r\nCopyright ACME Corp. and others"]
    body = ["copyright notice, this list", "Copyright License. Subject to the terms", "(c) You must retain", "Copyright and Related Rights",
            "COPYRIGHT HOLDERS OR ANYONE", "Copyright (C) <year> <name of author>", "copyright is kept by us", "All rights reserved words follow"]
    docs = spark.createDataFrame(list(enumerate([*texts, changed, lost, *notices, *body])), "doc_id long, text string")
    got = [r for r in licenses.scan(docs, licenses.known_licences(spark)).orderBy("id").collect()]
    n = len(texts)
    assert [r["whole_license"] for r in got[:n]] == want
    assert got[n]["whole_license"] is None and got[n + 1]["whole_license"] is None
    assert [r["text_digest"] for r in got[n + 2:n + 2 + len(notices)]] == [None] * len(notices)
    kept = spark.createDataFrame(list(enumerate(body)), "i long, t string").select("i", licenses.canonical(F.col("t")).alias("c"))
    assert [len(r["c"].split()) for r in kept.orderBy("i").collect()] == [len(re.findall(r"\w+", x)) for x in body]


def test_standard_texts_match_entire(spark):
    texts, want = [], []
    for r in licenses.standard_texts():
        forms = [r["text"], *[f"{t}\n\nCopyright (c) 2020 Jane Roe\n\n{r['text']}" for t in r["titles"]],
                 *[f"{n}\n\n{r['text']}" for n in r["notices"]], *[f"{r['text']}\n\n{a}" for a in r["appendices"]]]
        forms += [reset(forms[-1], w) for w in (0, 58, 66, 72, 80, 100)]
        texts += [*forms, r["text"] + " extra"]
        want += [r["name"]] * len(forms) + [None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = licenses.known_licences(spark).unionByName(licenses.standard_licences(spark))
    got = [r["whole_license"] for r in licenses.scan(docs, known).orderBy("id").collect()]
    assert [(t[:60], len(t), g, w) for t, g, w in zip(texts, got, want) if g != w] == []
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0",
            "Unlicense", "BSL-1.0", "MIT", "ISC", "Zlib"} == {w for w in want if w}


def test_registered_query_knows_the_standard_texts(spark, tmp_path):
    table = {r["name"]: r for r in licenses.standard_texts()}
    texts = ["MIT License\n\nCopyright (c) 2020 Jane Roe\n\n" + licenses.MIT, table["Apache-2.0"]["titles"][0] + "\n\n" + table["Apache-2.0"]["text"]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries_scan.op5_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["whole_license"] for r in got] == ["MIT", "Apache-2.0"]


def test_names_by_initials_capitals_and_cues(spark):
    hidden = {"I met John F. Kennedy.": "Kennedy", "Dr. J. Smith came.": "Smith", "Mr SMITH came.": "SMITH",
              "JOHN SMITH and others": "SMITH", "My name is Zebulon Quarrington.": "Quarrington", "Dear Zebulon Quarrington,": "Zebulon",
              "Sincerely,\nZebulon Quarrington": "Quarrington", "Меня зовут Зебулон Кваров.": "Кваров",
              "Emma Brown called Lukas Weber.": "Weber", "Contact Ethan Clark": "Clark", "My name is Wei Zhang": "Zhang"}
    clean = ["The Apple Store opened.", "Dear customer, please wait.", "my name is not known", "Regards, and so on.",
             "JOHN is a gospel.", "It is called New.", "A. B. testing", "THE DR IS IN"]
    rows = [(i, t) for i, t in enumerate([*hidden, *clean])]
    got = {r["doc_id"]: r for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for i, (t, word) in enumerate(hidden.items()):
        assert word not in got[i]["text"] and got[i]["pii_kinds"] == ["person"], (t, got[i]["text"])
        assert got[i]["text"].count(" ") == t.count(" ")
    for i, t in rows[len(hidden):]:
        assert got[i]["text"] == t and got[i]["n_mentions"] == 0
    assert got[2]["text"].split()[1].isupper() and got[0]["text"].split()[3][1] == "."
    # initials of any number stay possible: they need not be distinct
    many = [(i, f"Dr. {chr(65 + i % 26)}. Name{chr(97 + i % 26)}") for i in range(40)]
    assert pii.replace_pii(spark.createDataFrame(many, "doc_id long, text string"), "k").where("n_mentions = 1").count() == 40
