"""Every operator against brute force on a small table with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import decontam, language, lines, linking, media, neardup, packing, preferences, substrings, toxicity, weak_labels

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, bucket string, component long, kept string, score string, removed_lines string"


def words(rng, n, base="abcdefgh"):
    return " ".join("".join(rng.choice(base) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    rng = random.Random(7)
    texts = {i: "\n".join(words(rng, rng.randint(4, 40)) for _ in range(rng.randint(1, 6))) for i in range(40)}
    for i in range(40, 52):  # near copies of three documents, with one word changed
        parts = texts[i % 3].split(" ")
        parts[rng.randrange(len(parts))] = "zzz"
        texts[i] = " ".join(parts)
    texts[52], texts[53] = texts[5], texts[5]  # exact copies
    texts[54] = texts[6] + "\n" + texts[7]
    texts[55], texts[56], texts[57], texts[58] = None, "", "  \n\t ", "a"
    texts[59] = words(rng, 30_000)
    texts[60] = "x" * 400
    texts[61] = texts[8].upper()
    texts[62] = "ăî ß 漢字 éa\n" * 30
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else None, "s", 1, 9, "b", 1, "k", "s", "r") for i, t in texts.items()]
    rows += [(None, "no id", "en", "s", 1, 9, "b", 1, "k", "s", "r")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_media_round_trip(docs, texts, empty):
    got = by_id(media.op1_media(docs))
    assert set(got) == set(texts)
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert "ok=1" in r.feature
    assert media.op1_media(empty).count() == 0


def test_media_offset_of_every_frame(spark):
    rows = [(1, "x" * 40_000), (2, None)]
    got = by_id(media.op1_media(spark.createDataFrame(rows, "doc_id long, text string")))
    stored = media.store_audio(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    read = by_id(media.read_audio(stored))
    for i, r in by_id(stored).items():
        want = media.parse(r.media).offsets
        assert got[i].frame_offsets == read[i].audio.frame_offsets == want and len(want) == got[i].frames
        assert all(r.media[at] == 0xFF and r.media[at + 1] >= 0xE0 for at in want)
    assert len(got[1].frame_offsets) > media.SEEK_POINTS


def test_media_resync_and_damage():
    stream = media.mux(bytes(range(256)) * 16)
    clean = media.parse(stream)
    assert (clean.crc_bad, clean.skipped, clean.vbr, clean.vbr_frames, clean.table_crc_ok, clean.music_crc_ok) == (0, 0, "Xing", clean.frames, True, True)
    assert clean.samples == 1152 * clean.frames
    at = clean.offsets[1]
    junk = stream[:at] + b"\xff\xfb\x00junk" + stream[at:]
    found = media.parse(junk)
    assert (found.frames, found.skipped, found.music_crc_ok) == (clean.frames, 7, False)
    bad = bytearray(stream)
    bad[at + 10] ^= 1
    assert media.parse(bytes(bad)).crc_bad == 1
    cut = media.parse(stream[:-200])
    assert cut.frames == clean.frames - 1 and cut.skipped > 0
    for nothing in (None, b"", b"\xff" * 50, b"ID3"):
        assert media.parse(nothing).frames == 0


def _by_bits(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ b) & 1 else 0)) & 0xFFFF
    return crc


def _bits(data):
    return [byte >> k & 1 for byte in data for k in range(7, -1, -1)]


@pytest.mark.parametrize("head, covered", [
    (b"\xff\xfe\x90\xc0", 128),  # Layer I, mono
    (b"\xff\xfe\x90\x00", 256),  # Layer I, stereo
    (b"\xff\xfe\x90\x40", 4 * (2 * 4 + 28)),  # Layer I, joint stereo from subband 4
    (b"\xff\xfc\xa4\xc0", None),  # Layer II, 48 kHz, mono: 27 subbands
    (b"\xff\xfc\x14\x00", None),  # Layer II, 48 kHz, stereo at 16 kbit/s each: 8 subbands
])
def test_frame_checksums_of_layers_one_and_two(head, covered):
    rng = random.Random(22)
    size = media._decode(head)[0]
    frames = []
    for _ in range(5):
        body = bytes(rng.randrange(256) for _ in range(size - 6))
        bits = _bits(body)
        if covered is None:
            stereo = head[3] >> 6 != 3
            widths = [4] * 2 + [3] * 6 if stereo else [4] * 11 + [3] * 12 + [2] * 4
            at = used = 0
            for w in widths:
                for _ in range(2 if stereo else 1):
                    used += any(bits[at:at + w])
                    at += w
            n = at + 2 * used
        else:
            n = covered
        frames.append(head + _by_bits(_bits(head[2:]) + bits[:n]).to_bytes(2, "big") + body)
    got = media.parse(b"".join(frames))
    assert (got.frames, got.crc_checked, got.crc_bad) == (5, 5, 0)
    frames[2] = frames[2][:6] + bytes([frames[2][6] ^ 0x80]) + frames[2][7:]
    assert media.parse(b"".join(frames)).crc_bad == 1


def test_parsing_cut_and_damaged_streams_never_fails():
    rng = random.Random(23)
    whole = media.mux(bytes(rng.randrange(256) for _ in range(3000)))
    vbri = b"\xff\xfb\x90\xc0".ljust(36, b"\0") + b"VBRI"
    for data in [*(whole[:k] for k in range(0, len(whole), 37)), *(vbri[:k] for k in range(41)), *((vbri + bytes(400))[:k] for k in range(30, 440, 3))]:
        media.parse(data, payload=True)
    for _ in range(300):
        data = bytearray(whole[: rng.randrange(600)] + bytes(rng.choice(b"\xff\xfb\xfaI3DTAGAPEVBRIXing\0") for _ in range(rng.randrange(200))))
        for _ in range(rng.randrange(20)):
            if data:
                data[rng.randrange(len(data))] = rng.randrange(256)
        media.parse(bytes(data), payload=True)


def test_crc16_against_its_definition():
    rng = random.Random(1)
    assert media.crc16(b"123456789") == 0xBB3D
    for n in (1, 255, 256, 257, 1000):
        data, crc = rng.randbytes(n), 0
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
        assert media.crc16(data) == crc


def test_preferences_mask_and_prefix(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "one two three"), (2, 0, "user", "hi"), (2, 1, "assistant", "<|im_end|> other reply"), (2, 2, None, None), (3, 0, "system", "s"), (None, 0, "user", "x")]
    out = preferences.op2_preferences(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.kind, r.chosen_id, r.rejected_id) for r in out) == [("degraded", 1, 1), ("degraded", 2, 2), ("sibling", 2, 1)]
    for r in out:
        assert r.n_prefix == 1 and r.prompt == "<|im_start|>user\nhi<|im_end|>\n"
        for text, mask in ((r.chosen_text, r.chosen_mask), (r.rejected_text, r.rejected_mask)):
            spans = [tuple(map(int, s.split(":"))) for s in mask.split(",")]
            assert all(text[a:a + n].endswith("<|im_end|>") and text[:a].endswith("assistant\n") for a, n in spans)
    assert next(r for r in out if r.chosen_id == 1).rejected_text == "<|im_start|>assistant\none two<|im_end|>\n"


def test_weak_labels_find_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.65, 0.6])
    votes = np.where(rng.random((len(truth), 5)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, share, right = weak_labels.estimate(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.02 and np.abs(right.mean(1) - accuracy).max() < 0.03
    assert ((post[at.ravel()] > 0.5) == truth).mean() > 0.95


def test_weak_labels_query(docs, texts, empty):
    got = by_id(weak_labels.op3_quality(docs))
    assert set(got) == set(texts) and all(0 <= r.score <= 1 for r in got.values())
    assert weak_labels.op3_quality(empty).count() == 0


def test_decontamination(spark, docs):
    items = [(1, "If Anna has 12 apples and buys 5 kg of pears for 12 euros then how many are left"), (2, None), (3, ""), (4, "short item here"), (5, "a plain passage that nobody ever copied into any of the other texts at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        (1, "so he said if anna has 12 apples and buys 5 kg of pears for 12 euros then how many are left ok", True),
        (2, "Now, if Anna has 30 apples and buys 7 kg of pears for 30 euros then how many are left", True),  # other values, consistent
        (3, "Now, if Anna has 30 apples and buys 7 kg of pears for 31 euros then how many are left", False),  # 12 became two values
        (4, "he has 12 apples and buys milk", False),
        (5, None, False),
        (6, "", False),
        (7, "this is a short item here indeed", True),
    ]
    found = decontam.op4_decontam(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in found} == {i for i, _, hit in texts if hit}
    assert {r.doc_id: r.n_changed > 0 for r in found}[2]
    assert decontam.op4_decontam(docs, bench.where("false")).count() == 0
    assert decontam.op4_decontam(docs.where("false"), bench).count() == 0


def test_decontamination_by_case_names_and_numbers(spark):
    items = [
        (1, "Tom has 5 apples. Ann has 3 pears. Tom gives Ann 2 apples. How many apples does Tom have left?"),
        (2, "Yesterday Anna met Bert and Carl in Rome before Oslo and Kiel were shown to Anna by Bert with Carl and others from Oslo"),
        (3, "The baker sold twenty-five loaves at $3 each and then bought two hundred and five eggs for the next day at $4"),
    ]
    texts = [
        (1, "Max has 7 apples. Eva has 4 pears. Max gives Eva 3 apples. How many apples does Max have left?", {1}),
        (2, items[0][1].lower(), {1}),
        (3, items[1][1].upper(), {2}),
        (4, "The baker sold 31 loaves at £6 each and then bought 150 eggs for the next day at £7", {3}),
        (5, "Max has 7 apples. Eva has 4 pears. Ida gives Eva 3 apples. How many plums does Uwe want?", set()),
        (6, "The baker sold bread at the market and then went home for the next day", set()),
    ]
    found = decontam.op4_decontam(spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, k) for i, _, hits in texts for k in hits}
    assert {r.doc_id: r.n_changed for r in found}[2] == {r.doc_id: r.n_changed for r in found}[3] == 0


def _forms(text):
    """(words, form, strict, literal) by the documented rules, a token at a time."""
    found = []
    for m in re.finditer(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|\d+(?:[.,:/]\d+)*|[%$€£¥°]", text):
        t = m.group()
        capital = len(t) > 1 and t[0].isupper() and t[1].islower()
        before = text[max(0, m.start() - 2):m.start()]
        sure = capital and len(before) == 2 and before[1] in " \t" and (before[0].islower() or before[0].isdigit() or before[0] in ",;")
        found.append((t.lower(), sure, capital and not sure))
    words = [w for w, _, _ in found]
    also = {w for w, a, _ in found if a} & {w for w, _, b in found if b}

    def number(w):
        return w[0].isdigit() or w in decontam.NUMBER_WORDS

    literal = []
    for k, w in enumerate(words):
        unit = w in decontam.UNITS and k > 0 and number(words[k - 1]) or w in decontam.SIGNS and k + 1 < len(words) and number(words[k + 1])
        literal.append("<num>" if number(w) else "<unit>" if unit else w)
    strict = ["<name>" if found[k][1] else w for k, w in enumerate(literal)]
    form = ["<name>" if found[k][2] and found[k][0] in also else w for k, w in enumerate(strict)]
    return words, form, strict, literal


def _contaminated(text, item):
    """(matched, slots, changed) if at least half of the item's windows are found at consistent alignments."""
    dw, *ds = _forms(text)
    iw, *its = _forms(item)
    size = min(6, len(iw))
    if not size:
        return None
    n = len(iw) - size + 1
    shifts, blanks = collections.defaultdict(set), []
    for q in range(n):
        own = {tuple(f[q:q + size]) for f in its if set(f[q:q + size]) - set(decontam.PLACEHOLDERS)}
        if not own:
            blanks.append(q)
        for p in range(len(dw) - size + 1):
            if own & {tuple(f[p:p + size]) for f in ds}:
                shifts[p - q].add(q)
    covered, slots, changed = set(), [], []
    for shift, places in shifts.items():
        places |= {q for q in blanks if q + shift >= 0 and its[0][q:q + size] == ds[0][q + shift:q + shift + size]}
        at = {p for q in places for p in range(q, q + size) if its[0][p] in ("<num>", "<unit>", "<name>")}
        pairs = {(iw[p], dw[p + shift]) for p in at}
        if len({a for a, _ in pairs}) == len(pairs):
            covered |= places
            slots.append(len(pairs))
            changed.append(sum(a != b for a, b in pairs))
    return (n, len(covered), max(slots), min(changed)) if 2 * len(covered) >= n and covered else None


def test_lists_of_numbers_meet_no_numeric_item(spark):
    items = [(k, f"add {' '.join(str(7 * k + j) for j in range(30))}") for k in range(20)] + [(50, " ".join(map(str, range(12))))]
    numbers = " ".join(map(str, range(400)))
    changed = items[3][1].replace("add", "please add")
    changed = " ".join(str(int(w) + 900) if w.isdigit() else w for w in changed.split(" "))
    docs = spark.createDataFrame([(1, numbers), (2, f"{numbers} {changed} and {numbers}"), (3, items[50 - 30][1])], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_matched) for r in decontam.op4_decontam(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(2, k, 26) for k in range(20)}


def test_decontamination_by_brute_force(spark):
    rng = random.Random(27)
    base = ["the", "train", "leaves", "with", "apples", "km", "euros", "seven", "buys", "and", "pays", "from", "gives", "kg"]
    names = ["Anna", "Bert", "Carla", "Oslo", "Rome"]

    def sentence(n):
        out = [rng.choice(names) if rng.random() < 0.15 else str(rng.randint(1, 40)) if rng.random() < 0.2 else rng.choice(base) for _ in range(n)]
        return " ".join(out) + rng.choice([".", ", then", "?"])

    items = {i: " ".join(sentence(rng.randint(3, 9)) for _ in range(rng.randint(1, 3))) for i in range(12)} | {90: "", 91: "12 km", 92: None}
    docs = {}
    for k in range(60):
        text = rng.choice([items[i] for i in range(12)])
        if k % 3 == 1:
            text = re.sub(r"\d+", lambda m: str(int(m.group()) + 50), text)
        if k % 3 == 2:
            text = " ".join(w if rng.random() > 0.12 else rng.choice(base + names) for w in text.split(" "))
        docs[k] = f"{sentence(rng.randint(0, 6))} {text if k % 5 else text.lower()} {sentence(rng.randint(0, 6))}"
    docs |= {70: None, 71: "", 72: sentence(20), 73: " ".join(sentence(9) for _ in range(3000)) + " " + items[0]}
    want = {(d, i, *found) for d, t in docs.items() for i, x in items.items() if t and x and (found := _contaminated(t, x))}
    table = [spark.createDataFrame(list(x.items()), f"{key} long, text string") for x, key in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id, r.n_windows, r.n_matched, r.n_slots, r.n_changed) for r in decontam.op4_decontam(table[0].union(table[0].where("doc_id = 3")), table[1]).collect()}
    assert got == want and len(got) > 40
    assert decontam.op4_decontam(table[0].where("false"), table[1]).count() == 0 and decontam.op4_decontam(table[0], table[1].where("false")).count() == 0


def test_substrings(docs, texts, empty):
    got, seen = by_id(substrings.op5_substrings(docs)), set()
    for i, t in sorted(texts.items()):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if raw[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(raw[s:s + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert substrings.op5_substrings(empty).count() == 0


def test_language(spark, docs, texts, empty):
    rng = random.Random(5)
    rows = [(i, words(rng, 30, "aeiou" if i % 2 else "xyzwq"), "vow" if i % 2 else "con") for i in range(60)]
    got = by_id(language.op6_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert {i for i in got if got[i].held_out} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0}
    got = by_id(language.op6_language(docs))
    assert all((got[i].lang_pred == "und") == (not any(c.isalpha() for c in (t or ""))) for i, t in texts.items())
    assert language.op6_language(empty).count() == 0
    assert {r.lang_pred for r in language.op6_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_by_brute_force(spark):
    rng = random.Random(26)
    bases = {"aa": "abcdé", "bb": "cdefg", "cc": "efgaß"}
    rows = [(i, words(rng, rng.randint(1, 30), bases[lang]) + rng.choice(["", " 12!", "\n\n", " Ünx"]), lang) for i, lang in enumerate(sorted(bases) * 40)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "123 !?", "cc"), (503, "abc abc", None), (rows[3][0], rows[3][1], rows[3][2])]

    def grams(text):
        runs = re.sub(r"[^a-zéßüñ]+", "_", f" {(text or '').lower()} ")
        found = collections.Counter()
        for n in (1, 2, 3):
            for k in range(len(runs) - n + 1):
                g = runs[k:k + n]
                if g != "_" and "_" not in g[1:-1]:
                    found[g] += 1
        return found if runs.strip("_") else collections.Counter()

    def ranked(counts):
        return sorted(counts, key=lambda g: (-counts[g], g.replace("_", "\x01").rjust(3, "\0")))[: language.TOP]

    total = collections.defaultdict(collections.Counter)
    for i, text, lang in rows:
        if lang and zlib.crc32(str(i).encode()) % 5:
            total[lang].update(grams(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c))} for lang, c in total.items()}
    got = {(r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.op6_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    want = set()
    for i, text, _ in rows:
        own = ranked(grams(text))
        away = sorted((sum(abs(p[g] - r) if g in p else language.TOP for r, g in enumerate(own)), lang) for lang, p in profiles.items())
        want.add((i, away[0][1], round(1 - away[0][0] / (language.TOP * len(own)), 9)) if own else (i, "und", 0.0))
    assert got == want


def test_language_chunks(monkeypatch):
    text = words(random.Random(2), 400)
    whole = language.ngram_counts(text)
    monkeypatch.setattr(language, "CHUNK", 97)
    parts = language.ngram_counts(text)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.op7_packing(docs).collect()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    for i, t in texts.items():
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        want = [(k, at, len(ids[at:at + 4096]), zlib.crc32(np.asarray(ids[at:at + 4096], "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i]) == want, i
    for _, own_rows in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in own_rows:
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.op7_packing(empty).count() == 0


def test_packing_of_special_tokens(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b 'tis <|endoftext|>", "<|ENDOFTEXT|> and é <|endoftext|>", "漢<|endoftext|>", "endoftext < | > plain"]
    got = by_id(packing.op7_packing(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, t in enumerate(texts):
        ids = [*own.encode(t, add_special_tokens=False).ids, 1]
        assert (got[i].length, got[i].ids_crc32) == (len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
    assert own.encode(texts[0], add_special_tokens=False).ids == [3306, 49407, 1002]


def test_cached_words_have_the_ids_of_the_tokenizer():
    own = packing.WordTokenizer(packing.default_tokenizer())
    rng = random.Random(24)
    every = [chr(c) for c in [*range(1, 0x300), *range(0x2010, 0x2030), 0x1E9E, 0x212A, 0x4E00, 0x1F600]]
    texts = [f"a{c}b {c} {c}{c}1 A{c}" for c in every]
    texts += ["".join(rng.choice(every if k % 3 else every[:0x90]) for _ in range(rng.randint(0, 40))) for k in range(4000)]
    texts += ["it's <|endoftext|> x", "<|StartOfText|>", "I'LL we'Ve ''s"]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    assert [t for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_packing_plan_covers_exactly():
    rng = random.Random(4)
    for n in (1, 50, 3000):
        demand = collections.Counter(min(4096, int(rng.lognormvariate(6, 1.2)) + 1) for _ in range(n))
        patterns, used = packing.plan(dict(demand)), collections.Counter()
        for items, times in patterns:
            assert sum(items) <= 4096
            for length in items:
                used[length] += times
        assert used == demand
        bound = -(-sum(k * v for k, v in demand.items()) // 4096)
        assert sum(t for _, t in patterns) <= bound * 1.03 + 1
    assert packing.plan({}) == []


def shingles(text, n=4):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = [x for x in re.split("[\x20\x09-\x0d]+", low) if x]
    return {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def components(keys, links):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {k: root(k) for k in keys}


def test_near_duplicates(docs, texts, empty):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = by_id(neardup.op8_neardup(docs))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(links) > 5
    assert neardup.op8_neardup(empty).count() == 0


def test_near_duplicates_of_a_repeated_id(spark):
    rng = random.Random(25)
    one, two = words(rng, 60), words(rng, 60)
    rows = [(1, one), (1, two), (2, one + " end"), (3, two + " end"), (4, words(rng, 60)), (2, one + " end")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in neardup.op8_neardup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 57, 1), (2, 58, 1), (3, 58, 1), (4, 57, 4)}


def test_near_duplicates_of_one_large_group(spark):
    rng = random.Random(11)
    base = words(rng, 120).split(" ")
    texts = {}
    for i in range(150):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = words(rng, 1)
        texts[i] = " ".join(own)
    sets = {i: shingles(t) for i, t in texts.items()}
    want = components(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = by_id(neardup.op8_neardup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == want


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    union = neardup.mix64(rng.integers(0, 1 << 62, 4000).astype(np.uint64))
    a, b = np.sort(union[:3600]), np.sort(union[400:])
    sk = [neardup.odd_sketch(neardup.minhash(h, neardup.SKETCH_SAMPLES)) for h in (a, b)]
    apart = int(np.bitwise_count(sk[0].view(np.uint64) ^ sk[1].view(np.uint64)).sum())
    estimate = 1 + neardup.SKETCH_BITS / (4 * neardup.SKETCH_SAMPLES) * np.log(1 - 2 * apart / neardup.SKETCH_BITS)
    assert abs(estimate - 0.8) < 0.03 and apart <= neardup.most_apart(80)


def test_toxicity(spark, docs, empty):
    rng = random.Random(9)
    rows = [(i, words(rng, 40) + (" " + rng.choice(["vermin", "verminous", "scoundrel"]) + " " + words(rng, 5) if i % 3 == 0 else "")) for i in range(600)]
    data = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(0, None), (None, 1)], "doc_id long, toxic int")
    got = by_id(toxicity.op9_toxicity(data, labels))
    assert all(got[i].predicted == int(i % 3 == 0) for i in got)
    assert all(r.nearest and r.terms for r in got.values() if r.predicted)
    none = labels.where("false")
    assert {r.score for r in toxicity.op9_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.op9_toxicity(empty, labels).count() == 0


def test_toxicity_of_ordinary_words(spark):
    rng = random.Random(19)
    rows = [(i, words(rng, 40)) for i in range(600)]
    toxic = {i for i, _ in rows if i % 10 == 3}
    known = [i for i in sorted(toxic) if zlib.crc32(str(i).encode()) % 5]
    rows += [(1000, rows[known[0]][1]), (1001, rows[known[1]][1] + " one more"), (1002, words(rng, 40)), (1003, rows[0][1])]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(600)], "doc_id long, toxic int")
    got = by_id(toxicity.op9_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels))
    assert [got[i].predicted for i in (1000, 1001, 1002, 1003)] == [1, 1, 0, 0]
    assert got[1000].nearest[0].doc_id == known[0] and got[1000].nearest[0].cosine > 0.999 and got[1000].terms
    assert "vermin" in toxicity.terms_of("x" * 50 + "vermin")


def test_search_by_all_words_is_exact():
    rng = random.Random(16)
    rows = [(i, i % 2, np.array(sorted(rng.sample(range(40), rng.randint(0, 6))), np.int32)) for i in range(300)]
    index = toxicity.WordIndex([f"w{i}" for i in range(40)], np.linspace(1, 3, 40), [(*r, np.full(len(r[2]), 2, np.int32)) for r in rows], k=7)
    dense = np.zeros((300, 40))
    for i, _, at in rows:
        dense[i, at] = index.unit(at, np.full(len(at), 2))
    for q in range(40):
        at, w, spelt = index.query([f"w{i}" for i in rng.sample(range(50), 5)])
        assert [f"w{i}" for i in at.tolist()] == spelt
        cosines = dense[:, at] @ w
        want = sorted((round(float(c), 6) for i, c in enumerate(cosines) if c > 0 and i != q), reverse=True)[:7]
        assert [c for _, c in index.neighbours(at, w, q)] == pytest.approx(want, abs=1e-5)


def test_lexicon_counts_by_brute_force():
    rng = random.Random(17)
    terms = sorted({"".join(rng.choice("abc^$") for _ in range(rng.randint(2, 4))) for _ in range(60)} | {"^abc$"})
    vectors = toxicity.Vectors(terms)
    for _ in range(50):
        found = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 9))]
        text = "".join(f"^{w}$" for w in found)
        want = {i: n for i, t in enumerate(terms) if (n := sum(text.startswith(t, k) for k in range(len(text))))}
        assert vectors.counts(found) == want
    assert toxicity.Vectors([]).counts(["abc"]) == {}


def test_block_max_search_is_exact():
    rng = random.Random(6)
    terms = [f"t{i}" for i in range(40)]
    rows = [(i, i % 2, {rng.randrange(40): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}) for i in range(500)]
    model = toxicity.Model(terms, np.linspace(1, 3, 40), rows, k=7)
    dense = {}
    for i, _, c in rows:
        at, w = model.vector(c)
        dense[i] = np.zeros(40)
        dense[i][at] = w
    for q in range(60):
        at, w = model.vector({rng.randrange(40): 1 for _ in range(3)})
        v = np.zeros(40)
        v[at] = w
        want = sorted((-round(float(v @ d), 9), i) for i, d in dense.items() if v @ d > 0 and i != q)[:7]
        got = [(-round(c, 9), int(model.ids[r])) for r, c in model.neighbours(at, w, q)]
        assert [c for c, _ in got] == pytest.approx([c for c, _ in want])


@pytest.mark.parametrize("crowd", [64, 2])
def test_lines(spark, texts, monkeypatch, crowd):
    monkeypatch.setattr(linking, "CROWD", crowd)
    monkeypatch.setattr(linking, "CELL", crowd)
    rng = random.Random(8)
    shared = [words(rng, n) for n in (3, 12, 20, 40)]
    own = dict(texts)
    own[91] = texts[59][:-9] + "another end"
    own[92] = "-----\n" + "-" * 90 + "\n" + "=-" * 9 + "\n" + "-=" * 70
    own[93] = "\n".join(f"{shared[3][:60]} {words(rng, 8)}" for _ in range(40))  # alike, but not enough
    for k in range(70, 90):
        parts = [shared[k % 4], words(rng, 10), shared[(k + 1) % 4][:-1] + "q", ""]
        own[k] = "\n".join(parts)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in own.items()], "doc_id long, text string, removed_lines string").repartition(3)
    places = collections.OrderedDict()
    for i, t in sorted(own.items()):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if re.search(r"\S", line):
                places.setdefault(line, []).append((i, k))
    sets = {x: {x[k:k + 5] for k in range(max(1, len(x) - 4))} for x in places}
    links = [(a, b) for a, b in itertools.combinations(sorted(places), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components(sorted(places), links)
    first = {}
    for x, p in places.items():
        first[root[x]] = min(first.get(root[x], (1 << 60, 0)), min(p))
    gone = collections.defaultdict(set)
    for x, p in places.items():
        for at in p:
            if at != first[root[x]]:
                gone[at[0]].add(at[1])
    got = by_id(lines.op10_lines(docs))
    for i, t in own.items():
        assert set(got[i].removed_lines) == gone[i], i
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i].kept_sha256 == (None if kept is None else hashlib.sha256(kept.encode()).hexdigest())
    assert lines.op10_lines(docs.where("false")).count() == 0


def test_line_keys_miss_hardly_any_pair(spark):
    rng = random.Random(18)

    def letters(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def shingles_of(x):
        return {x[k:k + 5] for k in range(max(1, len(x) - 4))}

    pairs = [(x, x + letters(1)) for x in (letters(8) for _ in range(300))] + [("aaaaaaa", "aaaaaaaaa"), ("-----", "-" * 300), ("-= " * 3, "= -" * 30)]
    for _ in range(1500):
        x = letters(rng.randint(5, 45))
        more = rng.randint(1, max(1, len(x) // 5))
        pairs.append((x, x + letters(more) if rng.random() < 0.7 else letters(1) + x + letters(1)))
    for _ in range(2000):  # long words
        x = list(" ".join(letters(rng.randint(9, 14)) for _ in range(10))[: rng.randint(102, 130)])
        y = list(x)
        for _ in range(rng.randint(1, 2)):
            y[rng.randrange(len(y))] = rng.choice("qxz")
        pairs.append(("".join(x), "".join(y)))
    pairs = [(x, y) for x, y in pairs if x != y and 100 * len(shingles_of(x) & shingles_of(y)) >= 80 * len(shingles_of(x) | shingles_of(y))]
    texts = [t for pair in pairs for t in pair]
    keys = collections.defaultdict(set)
    for r in lines.signatures(spark.createDataFrame(list(enumerate(texts)), "cid long, line string")).collect():
        keys[r.id].add(r.bucket)
    missed = [p for k, p in enumerate(pairs) if not keys[2 * k] & keys[2 * k + 1]]
    assert len(pairs) > 2500 and len(missed) <= 2
    assert not [x for x, _ in missed if len(shingles_of(x)) <= 9]
    sketches = lines.sketches(spark.createDataFrame(list(enumerate(texts)), "cid long, line string"))
    one, two = sketches.select("id", F.col("sketch").alias("sa")), sketches.select((F.col("id") - 1).alias("id"), F.col("sketch").alias("sb"))
    assert one.where("id % 2 = 0").join(two, "id").where(~lines.likely("sa", "sb")).count() == 0


def test_line_sketches_of_long_lines(spark):
    rng = random.Random(19)
    base = words(rng, 900)
    close = " ".join(w if rng.random() > 0.03 else "zzz" for w in base.split(" "))
    rows = spark.createDataFrame([(0, base), (1, close), (2, words(rng, 900)), (3, words(rng, 60)), (4, words(rng, 60))], "cid long, line string")
    found = lines.sketches(rows)
    both = found.select(F.col("id").alias("a"), F.col("sketch").alias("sa")).join(found.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), F.col("a") < F.col("b"))
    kept = {(r.a, r.b) for r in both.where(lines.likely("sa", "sb")).collect()}
    assert (0, 1) in kept and (0, 2) not in kept and (3, 4) not in kept


def test_line_numbers_are_exact_where_passages_repeat(spark):
    rng = random.Random(23)
    vocabulary = [words(rng, 1) for _ in range(40)]
    ordinary = [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(300)]
    close = []
    for x in ordinary:
        own = x.split(" ")
        own[rng.randrange(60)] = "zq"
        close.append(" ".join(own))
    periodic = [(w * 40)[:400] for w in ("abcdefgh ij, klm nopq; ", "| --- | :-- | --: ", "x" * 17 + "y", "ab cd ef ")]
    texts = [t for pair in zip(ordinary, close, strict=True) for t in pair] + periodic + ["a b a b", "ab", "a", "alone"]
    rows = spark.createDataFrame(list(enumerate(texts)), "cid long, line string")
    found = {r.cid: r for r in lines.with_numbers(rows).collect()}
    assert sum(found[k].n20 is None for k in range(600)) > 590  # words repeat, passages don't
    for k, x in enumerate(periodic, 600):
        assert found[k].n20 == len({x[i:i + 20] for i in range(len(x) - 19)}), x
    assert found[604].n5 == len({"a b a", " b a ", "b a b"})
    keys = collections.defaultdict(list)
    for r in lines.signatures(rows).collect():
        keys[r.id].append(r.bucket)
    assert not [k for k in range(300) if not set(keys[2 * k]) & set(keys[2 * k + 1])]
    assert max(len(keys[k]) for k in range(600)) < 60  # about 14
    long = rows.where("cid < 600").select("cid", "line", F.lit(None).cast("int").alias("sampled"))
    for plan in (lines._shingled(long, 20, "UTF-16BE", "sampled"), lines.sketches(long)):
        assert "lambda" not in plan._jdf.queryExecution().optimizedPlan().toString()  # no loop that isn't compiled


def test_line_sketches_of_long_periodic_lines(spark):
    rng = random.Random(29)
    base = words(rng, 30) + " "
    rows = spark.createDataFrame([(0, base * 7), (1, base * 60), (2, (words(rng, 30) + " ") * 60)], "cid long, line string")
    found = lines.sketches(rows)
    both = found.select(F.col("id").alias("a"), F.col("sketch").alias("sa")).join(found.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), F.col("a") < F.col("b"))
    kept = {(r.a, r.b) for r in both.where(lines.likely("sa", "sb")).collect()}
    assert kept == {(0, 1)}
