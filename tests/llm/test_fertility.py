import math
import re
from collections import Counter

import pytest

from procspark.llm.fertility import TOKENIZERS, fertility_rules, vocabularies

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.append(line)
    base = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit))
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    pieces, fallback, level = vocabularies(TOKENIZERS)
    ids = [t for x in w for t in pieces.encode(x)]
    if not w:
        return (*base, failed, None, None, None, None)
    n = max(len(ids), 1)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(ids).values())
    m = (base[1] / n, sum(map(bool, fallback[ids])) / n, entropy, base[1] / sum(len(level.encode_ordinary(" " + x)) for x in w))
    return (*base, failed, *(round(x, 9) for x in m))


GOOD = "The weather was mild and the river ran slowly past the old mill while people walked home after a long day of work. "
ROWS = [(1, GOOD, "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "en"), (5, "a b c\na b c\n\n\na b c", "en"),
        (6, "same words again here now " * 12, "en"), (7, "# * $ % & | < > ok", None), (8, "日本語 テキスト 漢字 ꙮ 𝒳𝒴 " * 5, None),
        (9, "x" * 50000, "en"), (9, GOOD + "été", "fr"), (None, GOOD * 1, "en"), (10, "\x0b\x0cé   z", "xx")]


def test_measures_equal_brute_force(spark):
    df = spark.createDataFrame([(*r, True) for r in ROWS], "doc_id long, text string, lang string, kept boolean")
    got = fertility_rules(df).collect()
    want = sorted(str((d, g, *brute(t))) for d, t, g in ROWS)
    assert sorted(str((r.doc_id, r.lang, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                       *(x if x is None else round(x, 9) for x in (r.chars_per_piece, r.byte_share, r.entropy,
                                                                   r.chars_per_byte_token)))) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)
    assert fertility_rules(df.limit(0)).count() == 0
    assert fertility_rules(df.drop("lang")).count() == len(ROWS)


def test_bands_reject_odd_texts_and_keep_the_rest(spark):
    vocab = "river mill people walked home after long day work house garden table window street market evening".split()
    clean = [(i, " ".join(vocab[(i * 7 + j * (i % 5 + 2)) % len(vocab)] + ("s" if (i + j) % 3 else "") + f" w{i}{j}"
                          for j in range(25)), "en") for i in range(60)]
    odd = [(100, " ".join(f"zq{i}xjkvwq#~^{i}%%" for i in range(40)), "en"), (101, "ꙮ☃𝒳𝒴ꙮ " * 4 + " ".join(
        chr(0x12000 + i) * 3 for i in range(60)), "en")]
    got = {r.doc_id: r.kept for r in fertility_rules(
        spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i, _, _ in clean) and not got[101]


@pytest.mark.parametrize("name", ["en", "de", "fr", "es"])
def test_good_documents_stay(spark, name):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    got = fertility_rules(docs).join(labels, "doc_id").where(f"lang = '{name}' and quality = 1 and not base_failed")
    assert got.where("not kept").count() == 0


def test_short_texts_are_held_against_the_bands(spark):
    vocab = "river mill people walked home after long day work house garden table window street market evening".split()
    clean = [(i, " ".join(vocab[(i * 7 + j * (i % 5 + 2)) % len(vocab)] + ("s" if (i + j) % 3 else "") for j in range(25)), "en")
             for i in range(60)]
    odd = [(100, " ".join(chr(0x12000 + i) * 3 for i in range(15)), "en")]
    got = {r.doc_id: r for r in fertility_rules(
        spark.createDataFrame(clean + odd, "doc_id long, text string, lang string")).collect()}
    assert not got[100].base_failed and not got[100].kept
