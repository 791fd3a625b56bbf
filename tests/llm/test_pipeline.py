import random
import string

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_ngram_join import brute as near_classes
from tests.llm.test_pii import base

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample():
    r = random.Random(12)
    words = {lang: ["".join(r.choices(letters, k=r.randint(3, 6))) for _ in range(200)] for lang, letters in (("en", "theardons"), ("fr", "éèuxlaqoi"))}
    rows = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        own = r.choices(words[lang], k=r.choice([10, 80, 200]))
        if i % 5 == 0:
            own.insert(3, r.choice(["a.b@c.de", "+1 (988) 555-2485", "4111 1111 1111 1111", "10.0.0.1"]))
        rows.append((i, " ".join(own), lang, f"s{i % 3}", 0))
    rows += [(100 + i, rows[i][1].upper() if rows[i][1].isascii() else rows[i][1], rows[i][2], "s9", 0) for i in range(0, 20, 3)]
    for i in (2, 7, 33):
        own = rows[i][1].split()
        rows.append((200 + i, " ".join([*own[:-1], "tail"]), rows[i][2], "s9", 0))
    return rows + [(300, None, "en", "s0", 0), (301, "12 34 56", "en", "s0", 0)]


def brute(rows):
    """The texts that stay, by doc_id, as packed."""
    rows = [(i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or "")]
    best = {}
    for i, t in rows:
        best[t.translate(LOWER)] = max(i, best.get(t.translate(LOWER), i))
    rows = [(i, t) for i, t in rows if i in best.values()]
    classes = near_classes(rows)
    out = {}
    for i, t in rows:
        if classes[i] == i:
            for start, _, end, kind in reversed(base(t)):
                t = f"{t[:start]}<{kind}>{t[end:]}"
            out[i] = t
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows = sample()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    want = brute(rows)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert set(got.doc_id) == set(want) and len(want) < len(rows) - 8
    for i, own in got.groupby("doc_id"):
        assert own.length.sum() == own.doc_tokens.iloc[0] == len(whole.encode(want[i], add_special_tokens=False).ids) + 1
    assert got.groupby("sequence_id").length.sum().iloc[:-1].eq(2048).all()


def test_all_stages_but_the_last_keep_the_columns(spark):
    docs = spark.createDataFrame(sample(), SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
