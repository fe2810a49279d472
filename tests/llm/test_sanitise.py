import hashlib
import math
import random
import re

import pytest
from samples import make, prose
from test_text_operators import brute_spans

from nearkin.llm import sanitise

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def term(word):
    return len(word.encode()) >= 4 and not re.fullmatch("[0-9]+", word)


def brute_pairs(texts, support=3, generalise=0.6, remove=0.9, reach=128):
    """{(entity, term): (kind, keep)} from sets of texts, one after another."""
    texts = sorted({t for t in texts if t})
    entity_in, term_in, both, class_in = {}, {}, {}, {}
    for t in texts:
        words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(lower(t))]
        for _, _, x in words:
            if term(x):
                term_in.setdefault(x, set()).add(t)
            for n in (3, 4, 5, 6):
                if len(x) > n:
                    class_in.setdefault(x[:n], set()).add(t)
        spans = brute_spans(t)
        free = [(s, e, x) for s, e, x in words if term(x) and all(b <= s or e <= a for a, _, b in spans)]
        for a, kind, b in spans:
            entity = (sanitise.KINDS[kind], t[a:b])
            entity_in.setdefault(entity, set()).add(t)
            near = [w for w in words if w[1] <= a][-reach:] + [w for w in words if w[0] >= b][:reach]
            for w in near:
                if w in free:
                    both.setdefault((entity, w[2]), set()).add(t)
    out, n = {}, len(texts)
    for (entity, x), held in both.items():
        n_e, n_et, n_t = len(entity_in[entity]), len(held), len(term_in[x])
        if n_e < support or n_et < support:
            continue
        information = max(math.log2(n / n_e), 1e-9)
        share = math.log2(n * n_et / (n_e * n_t)) / information
        if share >= generalise:
            safe = [k for k in (3, 4, 5, 6) if len(x) > k and math.log2(n / len(class_in[x[:k]])) < generalise * information]
            out[entity, x] = (5, 0) if share >= remove else (4, max(safe, default=0))
    return out


def brute_added(text, pairs):
    spans = brute_spans(text)
    own = {(sanitise.KINDS[k], text[a:b]) for a, k, b in spans}
    out = {}
    for m in WORD.finditer(lower(text)):
        found = [v for (e, x), v in pairs.items() if x == m[0] and (v[0] == 5 or e in own)]
        if found and all(b <= m.start() or m.end() <= a for a, _, b in spans):
            out[m.start(), m.end()] = (max(v[0] for v in found), min(v[1] for v in found))
    return sorted((s, k, e, keep) for (s, e), (k, keep) in out.items())


@pytest.fixture(scope="module")
def disclosing():
    rng = random.Random(4)
    rows = [(i, prose(rng, 30)) for i in range(200)]
    rows += [(300 + i, f"{prose(rng, 5)} é Zorbulon wrote from zed@mail.example.com {prose(rng, 25)} and ZORBULON again") for i in range(6)]
    rows += [(400, f"{prose(rng, 12)} Zorbulon alone {prose(rng, 12)}")]  # without the address
    # in most, not all, of the texts that have it: generalised to its beginning, which many words share
    rows += [(500 + i, f"{prose(rng, 8)} Parisian of fay@mail.example.com 10.1.2.{i} {prose(rng, 8)}") for i in range(5)]
    rows += [(520 + i, f"{prose(rng, 8)} parisian {prose(rng, 8)}") for i in range(16)]
    rows += [(540 + i, f"{prose(rng, 8)} paris{rng.choice('abcdefgh')}{i} {prose(rng, 8)}") for i in range(90)]
    rows += [(640 + i, f"{prose(rng, 8)} parking {prose(rng, 8)}") for i in range(60)]
    # behind the reach of the method
    rows += [(700 + i, f"Quexotic {prose(rng, 150)} far@mail.example.com") for i in range(4)]
    # copies are one text
    rows += [(800 + i, "copy of one passage ann@mail.example.com with Copious words") for i in range(9)]
    rows += [(900, None), (901, ""), (902, "4242 4242 4242 4242"), (300, "the same id")]
    return rows


def test_sanitising_equals_brute_force(spark, disclosing):
    pairs = brute_pairs([t for _, t in disclosing])
    assert {v[0] for v in pairs.values()} == {4, 5} and any(k for _, k in pairs.values())
    got = sorted((r["doc_id"], [tuple(s) for s in sorted(r["added"])]) for r in sanitise.personal_data(make(spark, disclosing)).collect())
    assert got == sorted((i, brute_added(t or "", pairs)) for i, t in disclosing)


def test_planted_disclosures_are_found_and_others_stay(spark, disclosing):
    texts = [(i, t) for i, t in disclosing if t != "the same id"]
    found = sanitise.personal_data(make(spark, texts))
    named = {r["doc_id"]: [(dict(texts)[r["doc_id"]][s["start"] : s["end"]], s["kind"]) for s in r["added"]] for r in found.collect()}
    assert all(("Zorbulon", 5) in named[300 + i] and ("ZORBULON", 5) in named[300 + i] for i in range(6))
    assert ("Zorbulon", 5) in named[400]
    assert all(("Parisian", 4) in named[500 + i] for i in range(5)) and not any(named[520 + i] for i in range(16))
    assert not any("Quexotic" in dict(named[700 + i]) for i in range(4)) and not named[800]
    assert not any(named[i] for i in range(200))
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(make(spark, texts), found).collect()}
    assert "Zorbulon" not in clean[300] and "[EMAIL]" in clean[300] and clean[900] is None
    assert re.search(r"Pari?s?i?\* of \[EMAIL\] \[IP\]", clean[500])
    digest = sanitise.span_digest(found).where("doc_id = 300").first()
    base = ",".join(f"email:{s}:{e}" for s, _, e in brute_spans(dict(texts)[300]))
    assert digest["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and digest["n_email"] == 1 and base in digest["spans"] and "remove:" in digest["spans"]


def test_filters_stay_bounded_and_let_all_their_hashes_through(spark, monkeypatch):
    import numpy as np

    from nearkin.llm import textcore

    rows = spark.range(5000).selectExpr("xxhash64(id) as h")
    hashes = np.array([r["h"] for r in rows.collect()]).view(np.uint64)
    for most in (1 << 26, 1 << 12):  # the smaller one is far too full
        monkeypatch.setattr(textcore, "FILTER_MOST", most)
        bits = textcore.hash_filter(rows, "h").value
        assert len(bits) * 8 <= max(most, 1 << 12) and textcore.passing(bits, hashes).all()
    assert textcore.hash_filter(rows.where("h is null"), "h") is None
