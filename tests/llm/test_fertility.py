import base64
import math
import random
from collections import Counter

import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wattledger.llm import bpe, fertility

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SPACE = " \t\n\r\x0b\x0c"


def plain_words(text):
    out, word = [], ""
    for c in text + " ":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def plain_base(text):
    words = plain_words(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if plain_words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab#é \n\t\x1c| ", max_size=300), max_size=4))
def test_base_counts(texts):
    for text, row in zip(texts, fertility.measure_texts(texts, PIECES, RANKS)):
        assert row[:6] == plain_base(text)


def test_measures_word_by_word():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice(["the", "ing", "ß", "中", "🜁", "tion", "q"]) for _ in range(3)) for _ in range(80))
    row = fertility.measure_texts(["", text, "x " * 10], PIECES, RANKS)[1]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    enc: tiktoken.Encoding = bpe.encoding(RANKS)
    words = plain_words(text)
    ids = [i for w in words for i in model.encode(w)]
    chars = sum(map(len, words))
    assert math.isclose(row[8], chars / len(ids))
    assert math.isclose(row[9], chars / sum(len(enc.encode_ordinary(" " + w)) for w in words))
    assert math.isclose(row[10], sum(model.is_byte(i) for i in ids) / len(ids)) and row[10] > 0
    share = [n / len(ids) for n in Counter(ids).values()]
    assert math.isclose(row[11], -sum(p * math.log2(p) for p in share) / math.log2(min(len(ids), fertility.ENOUGH)))


def test_verdicts():
    prose = "This is a plain sentence about the weather and the people who like to speak of it on long walks. "
    rng = random.Random(1)
    vocabulary = prose.split() + "many other words make sure that nothing here repeats too often in one text at all".split()
    clean = " ".join(rng.choice(vocabulary) for _ in range(300))
    noise = " ".join("".join(rng.choice("🜁🜂🜃🜄🜅🜆") for _ in range(6)) for _ in range(300))
    rows = fertility.measure_texts([clean, noise], PIECES, RANKS)
    assert [r[6] for r in rows] == [True, False]
    assert fertility.script_of(["Привет"]) == "cyrillic" and fertility.script_of(["12"]) == "none"


def test_odd_tables(odd, make):
    got = fertility.measure(odd)
    assert got.columns == [c for c in odd.columns if c not in ("text", "kept")] + [n for n, _ in fertility.FIELDS]
    rows = {r["doc_id"]: r for r in got.collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    for k, text in texts.items():
        r = rows[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_base(text)
        assert not (r["base_failed"] and r["kept"])
    assert fertility.measure(make([])).count() == 0


#: Article 1 of the Universal Declaration of Human Rights in languages of each script.
CLEAN = {
    "latin": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης.",
    "cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה.",
    "arabic": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
    "devanagari": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "thai": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ",
    "kana": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "han": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다.",
}
LETTERS = {"greek": (0x3B1, 0x3C9), "cyrillic": (0x430, 0x44F), "hebrew": (0x5D0, 0x5EA), "arabic": (0x627, 0x64A), "devanagari": (0x905, 0x939),
           "thai": (0xE01, 0xE2E), "kana": (0x3041, 0x3093), "han": (0x4E00, 0x9FA5), "hangul": (0xAC00, 0xD7A3)}


def shuffled(text, n=120):
    """Words of a text in pieces of up to 12 characters, drawn so that no rule on repeats fails."""
    words = [w[i : i + 12] for w in text.split() for i in range(0, len(w), 12)]
    rng = random.Random(5)
    return " ".join(rng.choice(words) + ("" if i % 3 else ".") for i in range(n))


def random_words(letters, n=200, seed=7):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))


def verdicts(texts):
    return [(r[7], r[5], r[6]) for r in fertility.measure_texts(texts, PIECES, RANKS)]


def test_each_script_has_a_band_between_clean_text_and_noise():
    assert {s for s, _, _ in fertility.SCRIPTS} | {"none", "other"} == set(fertility.BANDS) and set(CLEAN) == {s for s, _, _ in fertility.SCRIPTS}
    for script, text in CLEAN.items():
        (found, _, _), = verdicts([text])
        row = fertility.measure_texts([text], PIECES, RANKS)[0]
        assert found == script and fertility._verdict(script, row[8], row[9], row[12], row[10], row[11]), script
    for script, (a, b) in LETTERS.items():
        letters = [chr(c) for c in range(a, b + 1) if chr(c).isalpha()]
        assert verdicts([random_words(letters)]) == [(script, False, False)], script


def test_latin_noise_is_rejected_and_prose_is_kept():
    rng = random.Random(9)
    noise = [
        random_words("bcdfghjklmnpqrstvwxz"), random_words("abcdefghijklmnopqrstuvwxyz"),
        random_words("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
        " ".join(base64.b64encode(rng.randbytes(57)).decode() for _ in range(60)), " ".join(rng.randbytes(8).hex() for _ in range(200)),
    ]
    assert [v[1:] for v in verdicts(noise)] == [(False, False)] * 5
    assert verdicts([shuffled(CLEAN["latin"])])[0] == ("latin", False, True)


def test_clean_documents_stay_and_spreads(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("quality = 1 and toxic = 0")
    got = fertility.measure(docs.select("doc_id", "lang", "text"))
    left = got.filter("not base_failed and n_repeat_words = 0")
    assert left.count() > 100 and left.filter("not kept").count() == 0
    row = fertility.spread(got, "lang", (0.0, 1.0)).filter("lang = 'en'").first()
    assert row["n"] > 50 and 1.5 < row["chars_per_wide_token"][0] <= row["chars_per_wide_token"][1]


def test_measures_do_not_depend_on_what_a_worker_keeps(monkeypatch):
    texts = [random_words("abcdefg", 60, k) + " " + CLEAN["greek"] for k in range(6)] + ["", "x" * 3000]
    fertility._words.cache_clear()
    alone = [fertility.measure_texts([t], PIECES, RANKS)[0] for t in texts]
    monkeypatch.setattr(fertility, "KEEP", 400)
    fertility._words.cache_clear()
    assert [fertility.measure_texts([t], PIECES, RANKS)[0] for t in texts] == alone == fertility.measure_texts(texts, PIECES, RANKS)
    fertility._words.cache_clear()
