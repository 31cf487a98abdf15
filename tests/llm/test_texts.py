import os

import pytest
from pyspark.sql import functions as F

from quarrylens.llm import bpe, language, mixture, repetition

TOKENIZERS = pytest.mark.skipif(not os.path.exists(f"{bpe.DEFAULT_FOLDER}/byte_bpe_50k.json"), reason="no tokenizer files")


def messy(df):
    return df.select("*", *[F.lit("clash").alias(c.upper()) for c in df.columns])


@pytest.fixture(scope="module")
def encoder():
    with open(f"{bpe.DEFAULT_FOLDER}/byte_bpe_50k.json", encoding="utf-8") as f:
        return bpe.ByteBpe.from_json(f.read())


@TOKENIZERS
def test_ids_are_those_of_the_library_and_decode_to_the_text(encoder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{bpe.DEFAULT_FOLDER}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    texts = ["", " ", "Hello  world's\n\n end", "<|endoftext|>", "Der Käufer zahlt 12,50 €", "ฝ่ายบัญชี เก็บ", "한국어 문장", "\x00\x01", "a" * 3000, "x=[1,2];\r\n\tif(y){}", "e\u0301 😀"]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert encoder.decode(ids) == t
    assert encoder.encode(None) == []


@TOKENIZERS
def test_encoding_frames(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, "x"), (2, None), (3, ""), (1, "a b")], "doc_id long, text string")
    rows = [(r.doc_id, list(r.ids)) for r in bpe.encode(messy(docs)).collect()]
    assert sorted(rows, key=str) == sorted([(1, [64, 275]), (1, [64, 275]), (None, [87]), (2, []), (3, [])], key=str)
    assert {(r.doc_id, r.text) for r in bpe.decode(bpe.encode(docs)).collect()} == {(1, "a b"), (None, "x"), (2, ""), (3, "")}
    assert bpe.encode(docs.where("false")).count() == 0


def test_plan_keeps_shares_and_caps():
    p = mixture.plan({"a": (0.5, 1), "b": (0.25, None), "c": (0.25, 2), "none": (0.1, 1), "zero": (0.0, 1)}, {"a": 100, "b": 10, "c": 1000, "zero": 5})
    assert set(p) == {"a", "b", "c"} and p["a"]["amount"] == 100 and p["a"]["capped"]
    assert abs(p["b"]["amount"] - p["c"]["amount"]) <= 1 and sum(x["amount"] for x in p.values()) == 1110
    assert mixture.plan({}, {"a": 1}) == {}


def test_points_are_exact_and_never_meet(spark):
    ids = [1, 2, 3, 2**31 - 1, 2**31, 10**11 + 7, 2**45 + 12345]
    frame = spark.createDataFrame([(i,) for i in ids], "i long").select("i", mixture.point(F.col("i")).alias("u"))
    assert {r.i: r.u for r in frame.collect()} == {i: i * mixture.GOLDEN % (1 << mixture.BITS) for i in ids}
    far = spark.range(10**11, 10**11 + 200_000).select(mixture.point(F.col("id")).alias("u"))
    assert far.distinct().count() == 200_000


def test_schedule_gives_every_block_once(spark):
    slots = {"a": 70_001, "b": 29_998, "c": 1, "d": 3}
    rows = mixture.schedule(spark, slots).collect()
    assert sorted((r.source, r.block) for r in rows) == [(s, k) for s in sorted(slots) for k in range(slots[s])]
    assert sorted(r.slot for r in rows) == list(range(sum(slots.values())))
    near = sum(r.source == "a" for r in rows if r.slot < 1000)
    assert abs(near - 700) <= 12


@TOKENIZERS
def test_mixture_is_whole_and_even(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (5 + i % 40), ["A_b", "a b", "c"][i % 3]) for i in range(300)] + [(999, None, "c"), (998, "", "c"), (997, "x", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a-b", 0.2, None), ("C", 0.6, 1), ("gone", 0.2, 1), ("d", None, None)], "source string, target_share double, max_repeats int")
    rows = mixture.mix(messy(docs), messy(targets), block=64).collect()
    report = {r.source: r for r in mixture.shares(docs, targets, block=64).collect()}
    for source, r in report.items():
        own = [x for x in rows if x.source == source]
        assert sum(x.token_to - x.token_from for x in own) == r.tokens
    assert report["c"].capped and report["c"].repeats == 1.0
    pieces = sorted((x.epoch, x.doc_id, x.token_from, x.token_to) for x in rows if x.source == "c")
    seen = {}
    for e, d, a, b in pieces:
        assert seen.get((e, d), 0) == a
        seen[(e, d)] = b
    slots = sorted({x.slot for x in rows})
    assert slots == list(range(len(slots)))
    half = [x for x in rows if x.slot < len(slots) / 2]
    share = sum(x.token_to - x.token_from for x in half if x.source == "c") / sum(x.token_to - x.token_from for x in half)
    assert abs(share - report["c"].actual_share) < 0.05
    assert mixture.mix(docs, targets.where("false")).count() == 0 and mixture.mix(docs.where("false"), targets).count() == 0


def plain_share(sequence, n):
    marked, seen = [0] * len(sequence), set()
    for i in range(len(sequence) - n + 1):
        run = tuple(sequence[i : i + n])
        if run in seen:
            marked[i : i + n] = [1] * n
        seen.add(run)
    return sum(marked)


def test_repeated_runs_agree_with_brute_force(monkeypatch):
    import random

    rng = random.Random(1)
    for large in (10**9, 0):
        monkeypatch.setattr(repetition, "LARGE", large)
        for _ in range(120):
            s = [rng.choice("abc") for _ in range(rng.randrange(60))]
            for n in (2, 3, 6, 20):
                assert repetition.repeated(s, n) == plain_share(s, n)


def test_found_repetition(spark):
    line = "The payroll run compares both totals before the month is closed. "
    thai = "ฝ่ายบัญชีเก็บค่าเดิมไว้เว้นแต่กลุ่มนั้น "
    varied = " ".join(f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "po", "ra") for b in ("den", "fol", "gim", "hat", "jur", "kel", "lop", "mys"))
    docs = [(1, line * 3), (2, line + "and nothing else is said here"), (3, None), (4, ""), (5, "12 34 --"), (6, thai * 3), (7, line.upper() + line.replace("totals", "totals,") + "12 " + line), (8, varied * 4000), (9, varied)] + [(100 + i, varied[i:] + f" x{i}") for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in repetition.found(messy(frame)).collect()} == {1, 6, 7, 8}
    assert repetition.found(frame.where("false")).count() == 0
    assert {r.doc_id for r in repetition.found(frame.where("doc_id in (3, 4, 5, 9)")).collect()} == set()


def test_no_case_outside_the_sample_is_lost(spark):
    """Plain, nearly repeating and extreme texts teach the forest; texts just over the limit, unlike all of them, still come out."""
    import random

    rng = random.Random(3)
    letters = "abdefgiklmnoprstuv"
    word = lambda: "".join(rng.choice(letters) for _ in range(6))
    plain = lambda n: [word() for _ in range(n)]

    def shared(n, k):
        """n words of which about k repeat, scattered in runs of six."""
        own = plain(n - k)
        return " ".join(own + [w for i in range(0, k, 6) for w in own[7 * i // 6 : 7 * i // 6 + 6]])

    texts = [(i, " ".join(plain(60))) for i in range(250)] + [(1000 + i, shared(100, 36)) for i in range(240)]
    texts += [(2000 + i, " ".join(plain(6) * 30)) for i in range(5)] + [(3000 + i, shared(100, 42)) for i in range(30)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    truth = {i for i, t in texts if repetition.repeat_share(t) >= 0.4}
    assert truth >= {3000, 2000} and len(truth) == 35
    for fit_rows in (20, 5000):
        assert {r.doc_id for r in repetition.found(frame, fit_rows=fit_rows).collect()} == truth
    judged = repetition.judge(frame, fit_rows=50).collect()
    assert all(r.short_share >= repetition.repeat_share(t) for r, (_, t) in zip(sorted(judged, key=lambda r: r.doc_id), texts))
    assert repetition.recall(frame).first().cases == 35


def test_isolation_finds_the_odd_rows():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(0, 0.01, (500, 3)), [[1, 1, 1], [0.9, 0, 1]]])
    scores = repetition.IsolationForest(rows).score(rows)
    assert set(np.argsort(-scores)[:2]) == {500, 501}
    labels = np.arange(502) >= 500
    assert repetition.calibrate(repetition.IsolationForest(rows), rows, labels) < scores[500:].min()


def test_codewords_keep_their_distance():
    code = language.codewords()
    assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 5


def test_labels():
    cases = {"EN": "en", "en-US": "en", "deu": "de", "Korean": "ko", "und": None, "": None, None: None, " - ": None, "it": "it", "pt_BR": "pt"}
    assert {k: language.label_code(k) for k in cases} == cases


SENTENCES = {
    "en": "The nightly batch keeps the previous amount until the payment arrives.",
    "de": "Das Lager vergleicht beide Summen, bis die Zahlung eingeht und der Monat endet.",
    "fr": "Le bon de livraison compare les deux totaux dès que la marchandise est arrivée.",
    "es": "El pedido se cierra cuando el cliente paga y la cuenta no tiene saldo.",
    "pt": "O pedido fica fechado quando o cliente paga e a conta não tem saldo.",
    "vi": "Đơn hàng được khóa sau khi khách hàng trả tiền và không còn số dư.",
    "ko": "모든 주문은 고객이 돈을 낸 뒤에 새 상태를 받는다.",
    "th": "รายการราคาต้องตรวจสอบจำนวนเงินเมื่อสินค้ามาถึงคลังกลาง",
}


def test_languages_of_sections(spark):
    rows = [(i, lang, text) for i, (lang, text) in enumerate(SENTENCES.items())]
    rows += [(20, None, SENTENCES["en"]), (21, "de", SENTENCES["en"]), (22, "English", SENTENCES["en"]), (23, "en", SENTENCES["en"] + " " + SENTENCES["de"]), (24, "en", None), (25, None, "   "), (26, None, "```\nimport x\nfor a in b: run the code now\n```"), (27, None, "gl_line = 7"), (28, "th", SENTENCES["th"] + " " + SENTENCES["fr"]), (29, "fr", "Le magasin vérifie `the open balance of all orders` avant la clôture du mois."), (30, "de", SENTENCES["de"].upper())]
    frame = spark.createDataFrame(rows, "section_id long, lang string, body string").withColumn("extracted_at", F.lit("2025-01-01").cast("timestamp"))
    again = frame.where("section_id = 20").withColumn("lang", F.lit("en")).withColumn("extracted_at", F.lit("2024-01-01").cast("timestamp"))
    got = {tuple(r) for r in language.found(messy(frame.unionByName(again))).collect()}
    assert got == {(20, "en"), (21, "en"), (23, "en"), (23, "de"), (28, "th"), (28, "fr")}
    parts = [(r.segment, r.lang) for r in language.language_segments(frame).where("section_id = 23").orderBy("segment").collect()]
    assert parts == [(0, "en"), (1, "de")]
    assert language.found(frame.where("false")).count() == 0


# Sentences of other matters than the tables hold, labelled by hand.
HELD_OUT = {
    "en": ["Two children were playing near the old bridge when it began to rain.", "She had never seen such a large herd of horses before.", "My neighbour grows tomatoes and beans behind his garage.", "The ferry leaves at dawn, so we slept badly.", "Nobody remembers who painted the kitchen green.", "Add the butter slowly and stir until the sauce thickens."],
    "de": ["Zwei Kinder spielten an der alten Brücke, als es zu regnen begann.", "Sie hatte noch nie eine so große Herde Pferde gesehen.", "Mein Nachbar züchtet Tomaten und Bohnen hinter seiner Garage.", "Die Fähre fährt im Morgengrauen ab, deshalb schliefen wir schlecht.", "Niemand weiß mehr, wer die Küche grün gestrichen hat.", "Die Butter langsam zugeben und rühren, bis die Soße dick wird."],
    "fr": ["Deux enfants jouaient près du vieux pont quand il a commencé à pleuvoir.", "Elle n'avait jamais vu un si grand troupeau de chevaux.", "Mon voisin fait pousser des tomates et des haricots derrière son garage.", "Le bateau part à l'aube, alors nous avons mal dormi.", "Personne ne se souvient de qui a peint la cuisine en vert.", "Ajoutez le beurre lentement et remuez jusqu'à ce que la sauce épaississe."],
    "es": ["Dos niños jugaban cerca del viejo puente cuando empezó a llover.", "Nunca había visto una manada de caballos tan grande.", "Mi vecino cultiva tomates y judías detrás de su garaje.", "El barco sale al amanecer, así que dormimos mal.", "Nadie recuerda quién pintó la cocina de verde.", "Añade la mantequilla despacio y remueve hasta que la salsa espese."],
    "pt": ["Duas crianças brincavam perto da velha ponte quando começou a chover.", "Ela nunca tinha visto uma manada de cavalos tão grande.", "O meu vizinho cultiva tomates e feijões atrás da garagem.", "O barco parte ao amanhecer, por isso dormimos mal.", "Ninguém se lembra de quem pintou a cozinha de verde.", "Junte a manteiga devagar e mexa até o molho engrossar."],
    "vi": ["Hai đứa trẻ đang chơi gần cây cầu cũ thì trời bắt đầu mưa.", "Cô ấy chưa bao giờ thấy một đàn ngựa lớn như vậy.", "Người hàng xóm của tôi trồng cà chua và đậu sau nhà.", "Chuyến phà rời bến lúc bình minh nên chúng tôi ngủ không ngon.", "Không ai nhớ ai đã sơn nhà bếp màu xanh."],
    "ko": ["비가 내리기 시작했을 때 아이 둘이 낡은 다리 옆에서 놀고 있었다.", "그녀는 그렇게 큰 말 떼를 본 적이 없었다.", "우리 이웃은 차고 뒤에서 토마토와 콩을 기른다."],
    "th": ["เด็กสองคนกำลังเล่นอยู่ใกล้สะพานเก่าเมื่อฝนเริ่มตก", "เธอไม่เคยเห็นฝูงม้าใหญ่ขนาดนี้มาก่อน", "เพื่อนบ้านของฉันปลูกมะเขือเทศและถั่วหลังบ้าน"],
    "und": ["Магазин закрыт, потому что хозяин уехал вчера вечером.", "Το μαγαζί είναι κλειστό επειδή ο ιδιοκτήτης έφυγε χθες.", "Sklep pozostaje zamknięty, ponieważ właściciel wyjechał wczoraj wieczorem.", "Dükkan kapalı çünkü sahibi dün akşam şehirden ayrıldı.", "Kauppa on kiinni, koska omistaja lähti eilen illalla kotiin.", "دکان بسته است چون صاحبش دیروز رفت"],
}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01/sections.parquet"
    if not os.path.exists(folder):
        pytest.skip("no test tables")
    model = language.fit([(r.lang, r.body) for r in spark.read.parquet(folder).orderBy("section_id").collect()])
    pairs = [(g, [x[1] for x in language.segments(model, [s])[0]]) for g, own in HELD_OUT.items() for s in own]
    right = sum(found == [g] for g, found in pairs)
    assert right / len(pairs) >= 0.9, [(g, f) for g, f in pairs if f != [g]]


def test_other_languages_are_a_parameter(spark):
    italian = ["Il negozio resta chiuso perché il proprietario è partito ieri sera.", "La bambina mangia una mela rossa sotto il grande albero.", "Nessuno ricorda chi ha dipinto la cucina di verde.", "Il mio vicino coltiva pomodori e fagioli dietro la sua casa."]
    rows = [("it", s) for s in italian] + [("en", s) for s in HELD_OUT["en"]]
    model = language.fit(rows, languages=["en", "it"])
    assert model.decode("Il bambino mangia sotto la casa di ieri.")[0] == "it" and model.decode("The bridge was old and the children were there.")[0] == "en"
