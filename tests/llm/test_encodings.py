"""Wrong encodings: round trips, held-out accuracy, texts that only look garbled."""

import random

import duckdb
import pytest

from tmloom.llm import encodings as N

WORDS = ["über", "Müller", "année", "réçu", "ação", "não", "Çelik", "naïve", "Straße", "œuvre", "l’été", "–", "„Zitat“", "coûts", "señor", "ÂNCORA", "EDUCAÇÃO", "Škoda"]


@pytest.fixture(scope="module")
def model():
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null order by doc_id").fetchall()]
    return N.ChainClassifier.fit(N.training_rows([" ".join(WORDS[::2]), *texts[::2]])), texts[1::2]


@pytest.mark.parametrize("name", N.CHAINS)
def test_round_trip(name):
    for w in WORDS:
        assert N.invert(N.garble(w, N.CHAINS[name]), N.CHAINS[name]) == w


def test_held_out_accuracy(model):
    m, held = model
    words = sorted({w for t in held for w in N.non_ascii_words(t)})
    clean = [w for w, (c, _) in zip(words, N.diagnose(words, m)) if c == N.CLEAN and N.plausible(w)]
    random.seed(2)
    hit = total = exact = 0
    for w in random.sample(clean, min(150, len(clean))):
        for chain in N.CHAINS.values():
            g = N.garble(w, chain)
            (label, back), = N.diagnose([g], m)
            total += 1
            hit += label != N.CLEAN
            exact += back == w
    assert hit / total > 0.97 and exact / total > 0.95


def test_not_garbled(model):
    m, _ = model
    for t in ["A AVALIAÇÃO de São João não é à toa", "L’ÂGE moyen à Paris", "Seitenlänge √88 m, Fläche ± 88 m²", "├── quelle\n│   └── teil", "Название: отчёт 788", "Π = 933 · Δt – Σ",
              "日本語のテキスト", "naïve café", "“Über” «à»", "5 € ½ © ®"]:
        assert N.repair_batch([1], [t], m).empty, t


def test_repair(model):
    m, _ = model
    clean = "Die Kosten für das Büro stiegen; l’année passée, não há."
    for name in ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "cp1252+cp1252"):
        got = N.repair_batch([7], [N.garble(clean, N.CHAINS[name])], m)
        assert got.restored_text.tolist() == [clean] and got.doc_id.tolist() == [7], name
    lost = clean.encode("latin-1", "ignore").decode("utf-8", "replace")
    got = N.repair_batch([8], [lost], m)
    assert got.chains.tolist() == [[N.LOST]] and got.restored_words.tolist() == [0]
    mixed = clean + " " + N.garble("Müller", N.CHAINS["latin-1"])
    assert N.repair_batch([9], [mixed], m).restored_text.tolist() == [clean + " Müller"]


def test_frames(spark):
    rows = [(1, "über Müller"), (2, None), (3, ""), (4, "plain"), (5, N.garble("über Müller", ("cp1252",))), (5, N.garble("über Müller", ("cp1252",))), (6, "a�b"),
            (7, N.garble("é" * 30_000, ("latin-1",))), (None, "Ã©")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in N.affected(df).collect()) == [5, 6, 7]
    assert N.affected(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_byte_encodings_read_as_another(model):
    m, _ = model
    for garbled, want in (("Mⁿller", "Müller"), ("Stra▀e", "Straße"), ("annйe", "année")):
        assert N.diagnose([garbled], m)[0][1] == want
    for w in ("x²yz", "a×bcde", "GmbH®Abc", "A™Bcd", "Δtest", "µmeter", "CO₂equiv", "naïve", "Название", "Αθήνα", "中文", "kW·hour"):
        assert N.diagnose([w], m)[0] == (N.CLEAN, w), w


def test_mixed_and_repeated_chains_are_undone_to_the_end(model):
    m, _ = model
    for chain in (("latin-1", "cp437"), ("cp437", "latin-1"), ("latin-1",) * 3, ("cp1252", "cp850")):
        label, back = N.diagnose([N.garble("Müller", chain)], m)[0]
        assert back == "Müller" and label.count("+") == len(chain) - 1


@pytest.mark.parametrize("word", ["отчёт", "Привет", "έκθεση", "中文", "報告"])
def test_other_scripts(model, word):
    m, _ = model
    assert N.diagnose([word], m)[0][0] == N.CLEAN
    for codec in ("latin-1", "cp1252", "cp437"):
        g = N.garble(word, (codec,))
        assert N.diagnose([g], m)[0][1] == word, codec
