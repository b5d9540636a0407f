"""Encoding repair, main bodies and spam: round trips and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa
import pytest

from orgweave.llm import encoding_repair as E
from orgweave.llm import main_text as M
from orgweave.llm import spam_pages as S

CLEAN = ["comunicação são joão", "telekommunikation süd köln", "światłowód łącza usługi", "hébergement télécom données", "informática española años", "připojení sítě české", "ооо связь телеком интернет",
         "kåsbrol nät sjö", "株式会社データ通信", "bilişim ağ hizmetleri", "conexión óptica cablevisión"]


@pytest.fixture(scope="module")
def counts():
    texts = [" ".join(x) for x in zip(CLEAN * 30, CLEAN[1:] * 33)] + CLEAN * 20
    b = next(E.count_cells(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["t"])])))
    c = np.zeros(E.ORDER * E.CELLS, np.int64)
    c[b.column(0).to_numpy()] = b.column(1).to_numpy()
    return c.reshape(E.ORDER, E.CELLS)


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1250"])
@pytest.mark.parametrize("times", [1, 2])
def test_round_trip(counts, wrong, times):
    for text in CLEAN:
        bad = text
        try:
            for _ in range(times):
                bad = bad.encode("utf-8").decode(wrong)
        except UnicodeDecodeError:
            continue
        found, restored, _ = E.judge([bad], counts)[0]
        assert found and restored == text, (bad, restored)


def test_clean_stay(counts):
    assert [bad for bad, _, _ in E.judge([*CLEAN, "plain ascii", ""], counts)] == [False] * (len(CLEAN) + 2)
    assert [bad for bad, fixed, _ in E.judge(["comunica��o", "s\x83o"], counts)] == [True, True]


def test_quick_repair():
    assert E.quick_repair("sÃ£o joÃ£o") == "são joão" and E.quick_repair(None) is None and E.quick_repair("são") == "são" and E.quick_repair("s�o") == "s�o"


def test_trained_and_repair(spark, scratch):
    rows = [(t, 0) for t in CLEAN * 5] + [("sÃ£o joÃ£o comunicaÃ§Ã£o", 0), (None, 0), ("", 0)]
    df = spark.createDataFrame(rows, "t string, text int")
    got = E.repair(df, "t", E.Trained(df, "t"), scratch).collect()
    assert ("sÃ£o joÃ£o comunicaÃ§Ã£o", "são joão comunicação") in {(r.text, r.restored) for r in got}
    empty = df.limit(0)
    assert E.repair(empty, "t", E.Trained(empty, "t"), scratch).count() == 0


def page(rng, style):
    words = "network fibre city region customers growth line market".split()
    body = [f"Acme {' '.join(rng.sample(words, 6))} since {rng.randrange(1990, 2020)}." for _ in range(4)]
    menu = rng.sample(["Home", "About us", "Contact", "Log in", "Careers", "Shop"], 4)
    foot = rng.sample(["All rights reserved", "Privacy policy", "Cookie settings", "Terms of use"], 3)
    if style == "html":
        return "\n".join(["<nav>", *(f"<li>{m}</li>" for m in menu), "</nav>", "<article>", *(f"<p>{b}</p>" for b in body), "</article>", "<footer>", *(f"<p>{f}</p>" for f in foot), "</footer>"]), set(range(7, 11))
    return "\n".join([*(f"* {m}" for m in menu), "", *body, "", *foot]), set(range(5, 9))


def test_main_text_held_out(spark):
    rng = random.Random(3)
    pages = [(n, page(rng, "html")[0], "Acme", 1) for n in range(80)]
    df = spark.createDataFrame(pages + [(900, None, None, 1), (901, "", "x", 1)], "page_id long, content string, org_name string, line_no int")
    table = M.learn_weights(df, "content", "org_name")
    for style in ("html", "plain"):
        good = total = 0
        for _ in range(30):
            text, truth = page(rng, style)
            total += 1
            good += set(M.main_lines(text, table, "Acme")) == truth
        assert good / total >= 0.9
    rows = M.extract_main(df.unionByName(df.limit(1)), "page_id", "content", "org_name", table)
    assert rows.count() == rows.distinct().count() and rows.where("page_id >= 900").count() == 0
    bodies = {r.page_id: r.body for r in M.extract_bodies(df.unionByName(df.limit(1)), "page_id", "content", "org_name", table).collect()}
    assert len(bodies) == 80 and all("Acme" in b and "<" not in b for b in bodies.values())
    assert not M.learn_weights(df.limit(0), "content", "org_name").any()


def test_tags_only_take():
    text, kind, _, tags = M.read_lines('<li><a href="/x">Home &amp; away</a></li>')[0]
    assert (text, kind, tags) == ("Home & away", "li", "a li")
    table = np.zeros(M.FEATURES, np.float32)
    _, _, marks = M.features(text, kind, tags)
    table[list(marks)] = 3.0
    assert M.main_lines("<p>one two</p>\n<li>three</li>", table) == []
    assert M.features("Acme grows", "p", "", ["Acme"]) != M.features("Acme grows", "p", "") and M.features("", "p", "")[2] == ()


def test_best_regions_is_best():
    rng = random.Random(1)
    for _ in range(40):
        scores, edges = [rng.uniform(-6, 6) for _ in range(8)], [rng.random() < 0.4 for _ in range(8)]

        def value(keep):
            total = sum(s for s, k in zip(scores, keep) if k)
            for k in range(1, 8):
                if keep[k] != keep[k - 1]:
                    total -= M.SWITCH_AT_EDGE if edges[k] else M.SWITCH_INSIDE
            return total

        best = max(value([bool(m >> k & 1) for k in range(8)]) for m in range(256))
        assert value(M.best_regions(scores, edges)) == pytest.approx(best)


def test_spam(spark):
    rng = random.Random(5)
    nouns = "council bridge cable letter storm engineer market village packet invoice harbour audit".split()
    prose = lambda: " ".join(f"The {rng.choice(nouns)} {rng.choice(['moved', 'opened', 'crossed'])} the {rng.choice(nouns)} of {rng.choice(nouns)}s in {rng.randrange(1900, 2020)}." for _ in range(rng.randrange(4, 14)))
    keys = ["cheap hosting", "best vpn", "buy router", "speed test"]
    spam = {
        1: ", ".join(rng.choice(keys) for _ in range(60)), 2: "\n".join(f"http://deal-{rng.randrange(9999)}.example/x{rng.randrange(999)}" for _ in range(30)),
        3: " ".join("#" + rng.choice(keys).replace(" ", "_") for _ in range(40)), 4: "\n".join(f"SKU {rng.randrange(99999)} | best vpn | buy router | cheap hosting | speed test" for _ in range(15)),
    }
    honest = {10: "\n".join(f"import: from AS{rng.randrange(4200000000, 4299999999)} accept ANY" for _ in range(25)), 11: "\n".join(f"2026-0{rng.randrange(1, 9)}-1{rng.randrange(9)} 0{rng.randrange(9)}:1{rng.randrange(9)} Exchange {c} session up" for c in nouns * 2),
              12: None, 13: "", 14: "  ", 15: prose() + "\nTags: best vpn, buy router"}
    rows = [(k, t, "en", 0) for k, t in (spam | honest).items()] + [(100 + n, prose(), rng.choice(["en", "EN", None, "xx"]), 0) for n in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, spam_share int")
    assert sorted(r.doc_id for r in S.find_spam(df, "doc_id", "text", "lang").collect()) == [1, 2, 3, 4]
    assert S.find_spam(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_sentences_and_numbers():
    assert S.sentence_density("The bridge moved to the market. It was old and very cold there.") > S.SENTENCES_PER_WORD
    assert S.sentence_density("cheap vpn. best router. buy cheap. vpn now. " * 9) == 0.0, "marks sprinkled over keywords end no sentence"
    assert S.sentence_density("") == 0.0 and S.sentence_density("株式会社データ通信東京大阪。") > 0
    pile, listing = "cheap vpn best router " * 40, "\n".join(f"AS{k * 7919 % 99991} peer {k * 104729 % 9973} up" for k in range(60))
    share = lambda b: S.numbers_share(b, S.compression(b)[1])
    assert share(pile) < S.NUMBERS < share(listing)
    assert S.judge_block(pile, -9.0, S.compression(pile)[1])[0] and not S.judge_block(listing, -9.0, S.compression(listing)[1])[0]
    assert S.judge_block(pile, -1.0, 0.0) == (False, 0.0), "what isn't redundant is no spam, however it repeats"


def test_every_name_is_put_to_the_chains(spark, scratch):
    long = "companhia telecom redes cablevision comunicaciones internet servicios de sistemas y conexiones"
    bad = f"{long} espaÒa"
    rows = [(t,) for t in CLEAN * 20 + [f"{a} {b} españa" for a in CLEAN for b in CLEAN] + [f"{long} {k}" for k in range(20)] + [bad]]
    df = spark.createDataFrame(rows, "t string").distinct()
    got = {r.text: r.restored for r in E.repair(df, "t", E.Trained(df, "t"), scratch).collect()}
    assert got == {bad: f"{long} españa"}


def test_no_chain_is_lost_to_the_beam(counts):
    bad = [t.encode("utf-8").decode("cp1252").encode("utf-8").decode("cp437") for t in CLEAN if _encodable(t)]
    wide, kept = E.best_chains(bad, counts, depth=2, beam=10**6, slack=1e9), E.best_chains(bad, counts, depth=2)
    best = lambda f: max((x for x in f if x), key=lambda x: x[1])[:2]
    assert bad and [best(f) for f in kept] == [best(f) for f in wide]


def _encodable(text):
    try:
        text.encode("utf-8").decode("cp1252").encode("utf-8").decode("cp437")
    except UnicodeDecodeError:
        return False
    return True


def test_a_first_step_that_reads_no_better_is_followed(counts):
    text = "comunicação são joão"
    bad = text.encode("utf-8").decode("latin-1").encode("utf-8").decode("mac_roman")
    assert E.judge([bad], counts)[0][:2] == (True, text)


def test_margin_is_validated():
    changed, missed = np.zeros(E.BINS), np.zeros(E.BINS)
    changed[[0, 1, 5, 11]] = 9000, 40, 20, 5
    missed[[2, 14, 30, 60]] = 10, 300, 500, 900
    margin = E.validate_margin(changed, missed, 0.1)
    assert 5 * E.BIN < margin <= 14 * E.BIN, "above nearly all mistakes, below nearly all damage"
    assert E.validate_margin(changed, missed, 0.9) <= margin, "more damage asks for less"
    assert np.isnan(E.validate_margin(np.zeros(E.BINS), missed, 0.1))


def test_planted_damage_comes_back(counts):
    for text in CLEAN:
        found = E.planted(text)
        if found:
            wrong, right = found[1].split(">")
            assert found[0] != text and text in E.recode(found[0], wrong, right)


def test_case_may_turn_with_the_encoding(counts):
    for wrong, right in (("cp1251", "koi8_r"), ("cp1252", "koi8_r"), ("mac_roman", "cp1251")):
        for text in ("связь телеком интернет", "ООО связь"):
            bad = text.encode(right).decode(wrong)
            assert text in E.recode(bad, wrong, right), (bad, wrong, right)
    assert not any("Oçã" in f or "COMUNICAç" in f for w in E.WRONG for r in E.RIGHT for f in E.recode("COMUNICAÇÃO", w, r))
    assert E.judge(["УЧСЪШ ФЕМЕЛПН ЙОФЕТОЕФ"], counts)[0][:2] == (True, "связь телеком интернет")


def every_chain(text, counts, depth):
    """The gains of the likeliest texts that UTF-8 steps alone give, and that other chains give, by trying each."""
    level, cost = {(text, True): 0.0}, {}
    for _ in range(depth):
        ahead = {}
        for (t, only), spent in level.items():
            utf8 = E.utf8_steps(t)
            steps = {f: (only, np.log(len(utf8))) for f in utf8}
            for fixed, (kind, price) in ({f: (False, E.OTHER_COST) for f in E.other_steps(t)} | steps).items():
                ahead[fixed, kind] = min(spent + price, ahead.get((fixed, kind), np.inf))
        for key, spent in ahead.items():
            cost[key] = min(spent, cost.get(key, np.inf))
        level = ahead
    alone = {t for t, only in cost if only} | {text}
    keys = [k for k in cost if k[0] != text and (k[1] or k[0] not in alone)]
    gains = E.scored([t for t, _ in keys], counts) - E.scored([text], counts)[0] - np.array([cost[k] for k in keys])
    return [max([0.0, *(g for (_, only), g in zip(keys, gains) if only == kind)]) for kind in (True, False)]


def test_every_chain_counts(counts):
    deep = "ооо связь".encode("koi8_r").decode("cp866").encode("utf-8").decode("cp1252").encode("utf-8").decode("mac_roman")
    texts = [*CLEAN, deep, "универ ûí îîî", "espaÒa Óptica", "ооо связь".encode("cp1251").decode("koi8_r").encode("cp866").decode("cp1251")]
    for found, margins in ((E.best_chains(texts, counts, 3), None), (E.best_chains(texts, counts, 3, margins=(2.0, 0.5)), (2.0, 0.5))):
        for text, pair in zip(texts, found):
            gains, all_gains = [f[1] if f else 0.0 for f in pair], every_chain(text, counts, 3)
            if margins:
                gains, all_gains = (max(0.0, *(g - m for g, m in zip(x, margins))) for x in (gains, all_gains))
            assert gains == pytest.approx(all_gains), text


def test_no_text_is_dropped_for_being_fifth(counts):
    bad = "comunicação são joão".encode("cp1252").decode("cp852").encode("cp1250").decode("cp852")
    assert E.judge([bad], counts)[0] == (True, "comunicação são joão", "cp852>cp1250 cp852>cp1252"), "the first step reads far worse than the record"


def test_quick_repair_reads_only_what_may_be_a_sequence(monkeypatch):
    read, plain = [], E.repair_utf8
    monkeypatch.setattr(E, "repair_utf8", lambda *a: read.append(a[1]) or plain(*a))
    assert E.quick_repair("žluť ¤ ‡") == "žluť ¤ ‡" and not read, "no two of its characters begin a sequence in any encoding"
    twice = "são".encode().decode("cp1252").encode().decode("cp437")
    assert E.quick_repair(twice + " joão") == "são joão" and len(set(read)) <= len(E.WRONG)


def test_blocks_are_compressed_once_for_all_classes(spark):
    rng = random.Random(8)
    rows = [(lang, " ".join(str(rng.random()) if rng.random() < 0.5 else "wide open road" for _ in range(rng.randrange(5, 90)))) for lang in ["en"] * 300 + ["de"] * 90 + ["xx"] * 20 + [None] * 10]
    slim = spark.createDataFrame(rows, "lang string, text string")
    by_class = {}
    for lang, text in rows:
        for block in S.blocks(text):
            size, ratio = S.compression(block)
            by_class.setdefault(("", size), []).append(ratio)
            by_class.setdefault((S.language(lang), size), []).append(ratio)
    usual = S.usual_ratios(slim)
    assert set(usual) == {k for k, r in by_class.items() if not k[0] or len(r) >= S.LEAST_BLOCKS}
    for key, (middle, spread) in usual.items():
        of = sorted(by_class[key])
        low, high = (of[int(np.ceil(p * len(of))) - 1] for p in (0.5, 0.84))
        assert (middle, spread) == pytest.approx((low, max(high - low, 0.02)))
    calls = spark.sparkContext.accumulator(0)
    plain = S.block_ratios

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield from plain(iter([batch]))

    S.block_ratios = counted
    try:
        S.usual_ratios(slim)
    finally:
        S.block_ratios = plain
    assert calls.value == len(rows), "each text is read once"


def test_last_steps_that_mend_nothing_are_not_made(counts, monkeypatch):
    texts = [*CLEAN, "ооо связь".encode("cp1251").decode("koi8_r")]
    expected, asked, plain = E.best_chains(texts, counts), [], E.utf8_steps
    monkeypatch.setattr(E, "utf8_steps", lambda text, among=-1: asked.append(among) or plain(text, among))
    assert E.best_chains(texts, counts) == expected and asked and 0 not in asked
    ceilings = E.Ceilings(counts)
    for text in ("связь", "Ð¡Ð²Ñ", "ãÃ¿þ", "são"):
        for most in (0, 1):
            missed = [sum(1 for run in E._HIGH.findall(text) for held in ceilings.lacking(run) if not held >> k & 1) for k in range(len(E.WRONG))]
            assert [ceilings.mending(text, most) >> k & 1 for k in range(len(E.WRONG))] == [n <= most for n in missed]
    assert set(E.written("são")) == {"são".encode(w, "lowbyte") for w in E.WRONG if set("ão") <= E.lowbyte_table(w)[1]}


def test_texts_that_lead_nowhere_are_left_before_the_last_step(counts, monkeypatch):
    texts = [*CLEAN, "ооо связь".encode("cp1251").decode("koi8_r"), "связь".encode("koi8_r").decode("cp866").encode("utf-8").decode("cp1252")]
    ceilings, rng, dropped = E.Ceilings(counts), random.Random(7), 0
    for text in texts:
        once = [*E.other_steps(text), *E.utf8_steps(text)]
        twice = [f for t in once for f in (*E.other_steps(t), *E.utf8_steps(t))]
        some = rng.sample(twice, min(len(twice), 40))
        for used in (-15.0, -25.0, -40.0):
            for t, kept in zip(some, ceilings.leads_on(some, [used] * len(some))):
                steps = E.other_steps(t)
                gains = [*E.scored([t, *E.utf8_steps(t)], counts), *(E.scored(list(steps), counts) - E.OTHER_COST)]
                assert kept or max(gains) <= used, t
                dropped += not kept
    assert dropped > 100
    asked, plain = [], E.Ceilings.of
    monkeypatch.setattr(E.Ceilings, "of", lambda self, ts, steps: asked.extend(ts if steps == 1 else []) or plain(self, ts, steps))
    found, few = E.best_chains(texts, counts), len(asked)
    monkeypatch.setattr(E.Ceilings, "leads_on", lambda self, ts, used: [True] * len(ts))
    assert E.best_chains(texts, counts) == found and few < (len(asked) - few) / 2, "what leads nowhere isn't scored, and nothing is lost by it"


def test_sequence_patterns_match_valid_sequences_alone():
    for wrong in E.WRONG:
        for bad in (b"\xe0\x80\xaf", b"\xed\xa0\x80", b"\xf0\x80\x80\xaf", b"\xf4\x90\x80\x80"):
            text = "".join(next(ch for ch, b in E.byte_map(wrong).items() if b == byte) for byte in bad)
            assert E.repair_utf8(text, wrong, False) == text and not E._sequence(wrong, False).fullmatch(text), (wrong, bad)
        for ch in "ࠀ퟿\U00010000\U0010ffffñ":
            text = "".join(next(c for c, b in E.byte_map(wrong).items() if b == byte) for byte in ch.encode())
            assert E.repair_utf8(text, wrong, False) == ch, (wrong, ch)
