import random
import re
import time

import messy
import pytest

from quern.llm import license as lic

TEMPLATES = {
    "A": 'Use <<beginOptional>>of this <<beginOptional>>fine<<endOptional>> work<<endOptional>> is granted to <<var;name="who";original="x";match=".{1,20}">> free of charge',
    "B": 'Copy <<var;name="year";original="2020";match="[0-9]{4}">> <<beginOptional>>by me<<endOptional>> all rights',
    "C": "is granted to",
}


BEGINNINGS = [["use", "is", "granted", "to"], ["use", "of", "this", "work", "is", "granted", "to"], ["use", "of", "this", "fine", "work", "is", "granted", "to"]]


def ends(name, words, at):
    """All tokens after which a run of the template from at may end: every way to cut the words."""
    if name == "C":
        return {at + 3} if words[at : at + 3] == ["is", "granted", "to"] else set()
    out = set()
    for begin in BEGINNINGS:
        a = at + len(begin)
        if words[at:a] == begin:
            out |= {z + 3 for z in range(a + 1, len(words) - 2) if words[z : z + 3] == ["free", "of", "charge"] and len(" ".join(words[a:z])) <= 20}
    return out


def test_against_every_way_to_read_a_template():
    """The longest accepted run from every token, and none where there is none."""
    rng = random.Random(2)
    words = "use of this fine work is granted to you and me free of charge copy 1999 by all rights".split()
    for name in ("A", "C"):
        t, hits, long = lic.compile_template(name, TEMPLATES[name]), 0, 0
        for _ in range(600):
            if rng.random() < 0.7:
                toks = ["use", *rng.choice([[], ["of", "this", "work"], ["of", "this", "fine", "work"], ["of", "work"]]), "is", "granted", "to", *[rng.choice(words) for _ in range(rng.randrange(5))], "free", "of", "charge", *rng.choice([[], ["free", "of", "charge"]])]
            else:
                toks = [rng.choice(words) for _ in range(8)]
            text = " ".join(toks)
            own = lic.tokens(text)
            for i in range(len(own)):
                got, want = lic.accept(t, own, text, i), ends(name, toks, i)
                assert (got[0] if got else None) == (max(want) if want else None), (text, i)
                hits += bool(got)
                long += len(want) > 1
        assert hits > 50 and (name == "C" or long)


def test_parts_without_a_bound():
    for pattern in (".+", ".*", ".{1,}"):
        t = [lic.compile_template("x", f'granted to <<var;name="who";original="x";match="{pattern}">> free of charge')]
        for n in (10, 60, 61, 500):
            names = " ".join(f"n{k}" for k in range(n))
            assert [f["parts"][0]["end"] for f in lic.scan(f"granted to {names} free of charge", t)] == [11 + len(names)], (pattern, n)


def test_wording_after_the_template_does_not_stand_for_its_end():
    ts = [lic.compile_template(n, s) for n, s in lic.TEMPLATES.items()]
    full = re.sub(r"<<(?:begin|end)Optional>>", " ", re.sub(r'<<var;[^>]*original="([^"]*)"[^>]*>>', r"\1", lic.TEMPLATES["ISC"]))
    assert [f["license"] for f in lic.scan(full, ts)] == ["ISC"]
    short = full[: full.index("IN NO EVENT")]
    assert lic.scan(short + "and so we say that everything else is as it may be, in this software", ts) == []


def test_many_notices_in_one_text():
    ts = [lic.compile_template(n, s) for n, s in lic.TEMPLATES.items()]
    text = "Released under the MIT License. " * 20_000
    began = time.monotonic()
    assert len(lic.scan(text, ts)) == 20_000
    assert time.monotonic() - began < 5
    assert len(lic.TEMPLATES) >= 15


def test_inner_matches_against_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice("ab") for _ in range(12)]
        ts = [lic.compile_template(str(k), " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 5)))) for k in range(4)]
        every = [f for t in ts for f in lic.scan(" ".join(words), [t])]
        kept = [a for a in every if not any(b["start"] <= a["start"] and a["end"] <= b["end"] and b["end"] - b["start"] > a["end"] - a["start"] for b in every)]
        assert lic.scan(" ".join(words), ts) == sorted(kept, key=lambda f: (f["start"], f["license"]))


def test_replaceable_and_optional_parts():
    ts = [lic.compile_template(n, s) for n, s in TEMPLATES.items()]
    text = "Hm. USE of this Work is granted to Bob & Sons, free-of charge. use of this fine work is granted to Al free of charge! Copy 1999 all rights"
    found = lic.scan(text.replace("free-of", "free of"), ts)
    assert [(f["license"], text.replace("free-of", "free of")[f["parts"][0]["start"] : f["parts"][0]["end"]]) for f in found] == [("A", "Bob & Sons"), ("A", "Al"), ("B", "1999")]
    for wrong in ("use of this is granted to Al free of charge", "use is granted to free charge", "copy 99 all rights", "use is granted to " + "x" * 21 + " free of charge"):
        assert not [f for f in lic.scan(wrong, ts) if f["license"] != "C"], wrong


def test_inner_matches_go_and_spellings_count():
    ts = [lic.compile_template(n, s) for n, s in TEMPLATES.items()]
    assert [f["license"] for f in lic.scan("use is granted to Al free of charge", ts)] == ["A"]
    mit = [lic.compile_template(n, s) for n, s in lic.TEMPLATES.items()]
    assert [f["license"] for f in lic.scan("This code is released under the MIT Licence.", mit)] == ["MIT-notice"]


@pytest.mark.parametrize("name", lic.TEMPLATES)
def test_every_template_accepts_its_own_wording(name):
    """With optional parts and without, and not with a mandatory word changed."""
    source = lic.TEMPLATES[name]
    t = lic.compile_template(name, source)
    fill = lambda s: re.sub(r'<<var;[^>]*original="([^"]*)"[^>]*>>', lambda m: m[1] or "2024 Someone", s)
    full = re.sub(r"<<(?:begin|end)Optional>>", " ", fill(source))
    bare = source
    while "<<beginOptional>>" in bare:
        bare = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>|<<endOptional>>).)*<<endOptional>>", " ", bare, flags=re.S)
    for text in (full, fill(bare), full.upper() if "match=\"[A-Z" not in source else full):
        assert any(f["license"] == name for f in lic.scan(text, [t])), text
    assert not lic.scan(re.sub(re.escape(t.anchor), "wrongword", full, flags=re.I), [t])


def test_markup_errors():
    for bad in ("<<beginOptional>>a", "a<<endOptional>>", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            lic.compile_template("x", bad)


def test_query_against_row_by_row(spark, sf):
    ts = [lic.compile_template(n, s) for n, s in lic.TEMPLATES.items()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = sorted((r.doc_id, f["license"], f["start"], f["end"]) for r in docs for f in lic.scan(r.text or "", ts))
    assert sorted((r.doc_id, r.license, r.start, r.end) for r in lic.op5(spark, sf).collect()) == want and want


def test_messy(spark):
    d = messy.docs(spark, [*messy.ROWS, (None, "Released under the MIT License", None, None), (30, "Released under the MIT License", None, None), (30, "Released under the MIT License", None, None), (31, "Released under the " * 20_000 + "MIT License", None, None)])
    rows = lic.find_licenses(d).collect()
    assert sorted((r.doc_id or 0, r.license) for r in rows) == [(0, "MIT-notice"), (30, "MIT-notice"), (30, "MIT-notice"), (31, "MIT-notice")]
    assert lic.find_licenses(d, {}).count() == lic.find_licenses(d.limit(0)).count() == 0


def test_a_pattern_has_its_own_bound():
    t = [lic.compile_template("x", 'granted to <<var;name="who";original="x";match=".{0,5000}">> free of charge')]
    for n in (10, 61, 300):
        names = " ".join(f"n{k}" for k in range(n))
        assert [f["parts"][0]["end"] for f in lic.scan(f"granted to {names} free of charge", t)] == [11 + len(names)], n
    assert not lic.scan("granted to " + "n" * 5001 + " free of charge", t)
