import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from samples import make, prose

from nearkin.llm import chat_format as chat
from nearkin.llm import language_id as lid
from nearkin.llm import media_columns as media
from nearkin.llm import sanitise
from nearkin.llm import sentencepiece_bpe as spm
from nearkin.llm import token_counts as counts
from nearkin.llm import webp
from nearkin.llm.queries import tokenizer
from nearkin.llm.textcore import Words, roll, starts_within, utf8

JSON, MODEL = tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def test_words_and_windows_follow_the_patterns():
    rng = random.Random(1)
    texts = ["", None, " ", *["".join(rng.choice(["a", "B", " ", "\n", "\x0b", "é", "9", "-", "_", "\x7f", "漢"]) for _ in range(rng.randint(0, 30))) for _ in range(300)]]
    data, offsets = utf8(pa.array(texts))
    for kind, pattern, lower in (("space", r"[^\x20\x09-\x0D]+", False), ("alnum", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", True), ("line", r"[^\n]+", False)):
        w = Words(data, offsets, kind, lower)
        seen = {}
        for i, t in enumerate(texts):
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or ""
            found = re.findall(pattern, t)
            assert w.counts()[i] == len(found)
            for k, word in enumerate(found):
                at = w.first[i] + k
                assert w.data[w.start[at] : w.end[at]].tobytes().decode() == word
                assert seen.setdefault(word, w.hash[at]) == w.hash[at]
        assert len(set(seen.values())) == len(seen)
    at, n = starts_within(w.first, 2)
    assert n.tolist() == [max(0, c - 1) for c in w.counts()] and len(at) == n.sum()
    assert roll(np.arange(3, dtype=np.uint64), 5).size == 0


BASE = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(BASE):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else 0, 14 <= len(digits) <= 19 and sanitise.luhn(digits), 10 <= len(digits) <= 15)[kind]
            if good:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    parts = ["a", "@", "b.c", ".", "1", "2", "4242 4242 4242 4242", "+1 (555) 123-4567", " ", "-", "255.1", "_", "%", "é", "+", "(", "0"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sanitise.base_spans(t) == brute_spans(t), t
    assert sanitise.base_spans("1" * 200_000) == [] and sanitise.base_spans("a" * 200_000 + "@") == []


def test_personal_data_handles_odd_rows(spark, corpus):
    got = sanitise.span_digest(sanitise.personal_data(make(spark, corpus)))
    assert got.count() == len(corpus) and got.where("spans <> ''").count() == 0
    assert sanitise.span_digest(sanitise.personal_data(make(spark, []))).count() == 0


def test_token_counts_equal_the_library(spark, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rng = random.Random(4)
    parts = ["  ", " ", "a", "b1", "\n", "é", "<|endoftext|>", "'s", "!", "　", "\x1c", "\t", "\xa0", "the", " of"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    assert all("".join(counts.pieces_of(t)) == t for t in texts)
    assert counts.count_texts(texts, JSON) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts.token_counts(make(spark, corpus), JSON).collect())
    want = [(d or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False)), False) for d, t, *_ in corpus]
    assert got == sorted((d, b, n, n > 512) for d, b, n, _ in want)
    assert counts.token_counts(make(spark, []), JSON).count() == 0


def test_very_long_texts_without_spaces():
    """Counts and ids of texts of several MB as the libraries give them."""
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(12)
    library = Tokenizer.from_file(JSON)
    han = "".join(rng.choice("漢字東京都大学文化中国日本語の、。!") for _ in range(200_000))
    code = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(400_000))
    texts = [han, code, han[:5000] + "<|endoftext|>" + code[:5000] + "'s1 it's'll" + code[:100]]
    assert all("".join(counts.pieces_of(t)) == t for t in texts)
    assert max(map(len, counts.pieces_of(han))) < 1000 and max(map(len, counts.pieces_of(code))) < 1000
    assert counts.count_texts(texts, JSON) == [len(e) for e in library.encode_batch(texts, add_special_tokens=False)]
    reference, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), spm.model(MODEL)
    long = "".join(rng.choice("etaoinshr") for _ in range(2_000_000))
    for t in (han, code, long):
        assert model.encode(t) == reference.encode(t)


def test_cuts_inside_long_pieces_change_no_count():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    rng = random.Random(13)
    parts = ["a", "Zx", "9", "12", "'", "'s", "'ll", "漢", "の", "、", "。", "!", "-", "é", "ß", "\n", "\t", "＠", "٣", "ก", "한", "<|endoftext|>", "_", "ʼ"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 30)))
        cut = counts.inner_pieces(t)
        assert "".join(cut) == t
        assert sum(len(e) for e in library.encode_batch(cut, add_special_tokens=False)) == len(library.encode(t, add_special_tokens=False)), t


def test_memory_of_segments_stays_bounded():
    from nearkin.llm.segment_memo import Memo

    memo = Memo(limit=3)
    for wanted in (["a", "b"], ["b", "c"], ["d"], ["a", "b", "c", "d", "e"]):
        for x in memo.missing(wanted):
            memo[x] = x
        assert all(x in memo for x in wanted) and len(memo) <= max(3, len(wanted))


def test_webp_reads_all_features_of_the_format():
    rng = np.random.default_rng(1)
    files, images = [], []
    for n, transforms in enumerate([(), (0,), (1,), (2,), (3,), (0, 1), (2, 0), (1, 2, 0), (3, 0)]):
        for cache, groups, references in ((0, 0, True), (4, 0, True), (10, 2, True), (0, 2, False), (3, 0, False)):
            h, w = (int(x) for x in rng.integers(1, 18, 2))
            colours = rng.integers(0, 2**32, [1, 3, 9, 40, 200][(n + cache) % 5], dtype=np.uint32)
            image = colours[rng.integers(0, len(colours), (h, w))]
            files.append(webp.write(image, transforms, mode=(n * 5 + cache) % 14, cache=cache, group_bits=groups, references=references))
            images.append(image)
    for f, image in zip(files, images, strict=True):
        assert (webp.read_many(webp.chunks_of(f))[0] == image).all()
    together = webp.read_many([c for f in files for c in webp.chunks_of(f)])
    assert all((a == b).all() for a, b in zip(together, images, strict=True))
    with pytest.raises(ValueError):
        webp.chunks_of(b"RIFFxxxxWAVE")
    with pytest.raises(ValueError):
        webp.chunks_of(files[-1][:-4])


def test_predictor_modes_round_trip():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 2**32, (9, 7), dtype=np.uint32)
    for mode in range(14):
        assert (webp.read_many(webp.chunks_of(webp.write(image, (0,), bits=2, mode=mode)))[0] == image).all()


def test_media_hold_the_whole_texts(spark, corpus):
    rows = [*corpus, (900, "a" * 64), (901, "\0" * 70), (902, "b" * 5000)]
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.read_media(media.store_media(make(spark, rows))).collect()}
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got[doc_id, hashlib.sha256(payload).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
    by_text = {}
    for r in media.store_media(make(spark, rows)).collect():
        by_text.setdefault(bytes(r["media"]), set()).add(r["n_bytes"])
    assert all(len(v) == 1 or min(v) == 0 for v in by_text.values())
    assert media.read_media(media.store_media(make(spark, []))).count() == 0
    pixels = media.pixel_arrays(media.store_media(make(spark, [(1, "xy")]))).first()
    assert (pixels["width"], pixels["height"], bytes(pixels["pixels"])) == (64, 1, b"xy" + bytes(62))


def brute_bits(train, text):
    """Code length of a text, straight from the definition."""
    from collections import Counter

    grams = [Counter() for _ in range(4)]
    for t in train:
        raw = bytes(3) + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                grams[k][raw[i - k : i + 1]] += 1
    after = [{} for _ in range(4)]
    for k in range(4):
        for g, n in grams[k].items():
            after[k].setdefault(g[:-1], {})[g[-1]] = n
    raw, bits = bytes(3) + text.encode(), 0.0
    for i in range(3, len(raw)):
        for k in (3, 2, 1, 0):
            own = after[k].get(raw[i - k : i])
            if not own:
                continue
            total, distinct = sum(own.values()), len(own)
            if raw[i] in own:
                bits -= np.log2(own[raw[i]] / (total + distinct))
                break
            bits -= np.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    train = ["the cat sat on the mat", "a theme", "", "théâtre"]
    data, offsets = utf8(pa.array(train))
    codes, n = np.unique(lid._grams(data, offsets), return_counts=True)
    scorer = lid.Scorer({"x": lid.ContextTrees(codes, n.astype(float))})
    texts = ["the hat", "", "zzz", "é", "a the cat"]
    got = scorer.lengths(*utf8(pa.array(texts)))[0]
    assert np.allclose(got, [brute_bits(train, t) for t in texts])


def test_languages_of_held_out_documents(spark):
    from nearkin.llm.queries import op4_language_id

    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = [r for r in op4_language_id(spark, "/root/testdata/sf0.001").collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.95 * len(got) > 0


def test_copies_do_not_displace_other_texts_in_training(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 20), "aa") for i in range(100)]
    copies = [(1000 + i, "zzz yyy " * 50, "aa") for i in range(2000)]
    labelled = lambda x: make(spark, x).select("text", "lang")
    one = lid.train(labelled([*rows, copies[0]]), 12_000)["aa"].levels
    many = lid.train(labelled([*rows, *copies]), 12_000)["aa"].levels
    assert all((x == y).all() for p, q in zip(one, many, strict=True) for x, y in zip(p[1:], q[1:], strict=True) if len(x) == len(y)) and [len(x[1]) for x in one] == [len(x[1]) for x in many]
    assert one[-1][2].sum() > 3_000


def test_language_of_odd_rows(spark, corpus):
    docs = make(spark, [*corpus, (7, "123 456 !!", None)])
    got = {r["doc_id"]: r for r in lid.identify(docs, lid.learned_from(docs)).collect() if r["doc_id"] is not None}
    for doc_id in (0, 1, 4, 7):
        assert (got[doc_id]["lang_pred"], got[doc_id]["score"], got[doc_id]["bits_per_byte"]) == ("und", 0.0, None)
    assert got[200]["lang_pred"] == "en"
    nothing = lid.identify(docs, lid.learned_from(docs).where("lang = 'xx'")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"} and len(nothing) == len(corpus) + 1
    assert lid.identify(make(spark, []), lid.learned_from(docs)).count() == 0


def test_sentencepiece_equals_the_library(spark, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    model = spm.model(MODEL)
    rng = random.Random(6)
    letters = "  ▁abcdeéthesan\n\t0019🙂　漢字ñ'\"<>s/[]\x00\x7f"
    for k in range(6000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) if k % 2 else "".join(rng.choice(model.pieces[3:]).replace("▁", " ") for _ in range(rng.randint(1, 5)))
        ids = model.encode(text)
        assert ids == library.encode(text), text
        assert model.decode(ids) == library.decode(ids)
    for n in range(80):
        assert model.encode(" " * n + "the") == library.encode(" " * n + "the")
    for _ in range(2000):
        ids = [rng.choice([rng.randint(3, 258), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 6))]
        assert model.decode(ids) == library.decode(ids)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in spm.encode_digest(make(spark, corpus), MODEL).collect())
    want = []
    for doc_id, text, *_ in corpus:
        ids = library.encode(text or "")
        want.append((doc_id or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    full = spm.encode_decode(make(spark, [(1, "hi there"), (2, None)]), MODEL).orderBy("doc_id").collect()
    assert (full[0]["ids"], full[0]["decoded"], full[1]["ids"], full[1]["decoded"]) == (library.encode("hi there"), "hi there", [], "")
    assert spm.encode_digest(make(spark, []), MODEL).count() == 0


def test_chat_segments_escape_and_come_back():
    rng = random.Random(7)
    for _ in range(3000):
        text = "".join(rng.choice([*chat.CONTROL, "\\", ":", "<", "[", "n", "\n", "x"]) for _ in range(rng.randint(0, 6)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROL)
    made, before = chat.assemble(pa.array(["user", None, "a\nb<s>"]), pa.array(["hi </s>", None, "é"]))
    assert [chat.parse(s) for s in made.to_pylist()] == [("user", "hi </s>"), ("", ""), ("a\nb<s>", "é")]
    with pytest.raises(ValueError):
        chat.parse("free text")


def test_chat_digests(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "ok </s>", "[INST] \\ é", "long " * 500])) for c in (1, 2, None) for t in range(rng.randint(1, 8))]
    rows += [(3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, None, "user", "x")]
    rows += [(6, 0, "assistant", x) for x in ("<s>", "<a", "<t", "\\:", "\\\\:", "[/INST]", "[0", "a", "a!", "a\\", "é")] + [(6, 0, None, "z"), (6, 0, "", "y")]  # ties
    rows += [(5, i, "user", "hot") for i in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segment", "2 AS seg_chars")
    got = {r["conv_id"]: r for r in chat.conversation_digest(chat.format_turns(frame)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv]["formatted_chars"] == sum(len(chat.TURN) + len(r) + 1 + len(chat.escape(x)) + len(chat.END) for _, r, x in own)
    assert chat.conversation_digest(chat.format_turns(frame.limit(0))).count() == 0
