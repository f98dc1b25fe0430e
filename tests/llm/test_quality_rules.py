import re
import unicodedata

import pytest

from phrasemill.llm import quality_rules as Q

from .data import LONG, OTHER, PROSE, documents, empty, hard, rows


def brute(text):
    t = text or ""
    w = [x for x in re.split(r"[\W_]+", "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t.lower())) if x]
    lines = t.split("\n")
    n = len(w)
    ratio = lambda a, b: a / b if b else 0.0
    return {
        "n_chars": len(t),
        "n_words": n,
        "mean_word_length": ratio(sum(map(len, w)), n),
        "symbol_ratio": ratio(len(re.findall(r"[#$%&*@^~|<>{}\[\]\\=+]", t)), len(t)),
        "exclamation_ratio": ratio(t.count("!") + t.count("?"), n),
        "stop_word_ratio": ratio(sum(x in Q.STOP_WORDS for x in w), n),
        "distinct_word_ratio": ratio(len(set(w)), n),
        "repeat_line_ratio": ratio(len(lines) - len(set(lines)), len(lines)),
        "words_a_line": ratio(n, len(lines)),
        "bar_ratio": ratio(t.count("|"), n),
    }


def verdict(s):
    out = []
    for r in Q.RULES:
        x = s[r.statistic]
        if s["n_words"] >= r.from_words and ((r.least is not None and x < r.least) or (r.most is not None and x > r.most)):
            out.append(r.name)
    return ",".join(out)


TEXTS = [PROSE, OTHER * 3, "BUY!! NOW!! CHEAP!!", "a | b | c | d", "x\n" * 9, "$$$ ### %%%", "Grüße aus Köln, ça va? Ñandú 123", LONG, "", None, " ", "spam " * 40, "qzx wvk jjj " * 20, "one\n\n\none"]


def test_against_plain_python(spark):
    found = {r.doc_id: r.asDict() for r in Q.verdicts(documents(spark, list(enumerate(TEXTS)))).collect()}
    for i, text in enumerate(TEXTS):
        own = brute(text)
        for name, x in own.items():
            assert found[i][name] == pytest.approx(x, abs=1e-12), (i, name)
        assert found[i]["broken_rules"] == verdict(own) and found[i]["is_kept"] == (verdict(own) == "")
    assert found[0]["is_kept"] and found[1]["is_kept"] and not found[2]["is_kept"] and not found[4]["is_kept"]


def test_one_projection_without_user_functions(spark, tmp_path):
    documents(spark, [(1, PROSE)]).write.parquet(str(tmp_path / "d"))
    plan = Q.verdicts(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_hard_rows_and_stage(spark):
    docs = hard(spark)
    out = Q.verdicts(docs)
    assert out.count() == docs.count()
    assert {r.doc_id for r in out.where("broken_rules LIKE '%no_words%'").collect()} == {None, 4, 5, 6, 7}
    kept = Q.passing(docs)
    assert kept.columns == docs.columns
    assert rows(kept) == sorted((tuple(r) for r in docs.collect() if verdict(brute(r.text)) == ""), key=repr)
    assert Q.verdicts(empty(spark)).count() == 0 and Q.passing(empty(spark)).count() == 0


def test_long_and_widely_spaced_texts_are_kept(spark):
    book = " ".join(f"word{i * i % 39989} of the" for i in range(60_000))  # 180,000 words
    dull = " ".join(f"word{i % 150} of the" for i in range(60_000))
    paragraphs = [f"{PROSE} Paragraph {i}." for i in range(6)]
    spaced = "\n\n\n".join(paragraphs)
    crlf = "\r\n\r\n\r\n".join(paragraphs)
    repeated = "\n\n\n".join([PROSE] * 6)
    texts = [book, "", dull, spaced, crlf, repeated]
    docs = documents(spark, list(enumerate(texts)))
    found = {r.doc_id: r.broken_rules for r in Q.verdicts(docs).collect()}
    ratios = {r.doc_id: r.distinct_word_ratio for r in Q.verdicts(docs).collect()}
    assert 0.05 < ratios[0] < 0.12
    assert "few_words" not in found[0] and "few_words" in found[2]
    assert (found[3], found[4], found[5]) == ("", "", "repeated_lines")
    assert {r.doc_id for r in Q.passing(docs).collect()} >= {0, 3, 4}


def test_values_on_a_threshold_break_nothing(spark):
    """Each text's statistic is just the bound; one step further breaks the rule."""
    words = lambda n: [f"q{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(n)]
    on = {
        "symbols": ("the " * 23 + "########", "the " * 23 + "#########"),  # 8 of 100
        "exclamations": (" ".join(words(20)) + "!" * 7, " ".join(words(20)) + "!" * 8),  # 7 of 20
        "stop_words": ("the " + " ".join(words(49)), "the " + " ".join(words(50))),  # 1 of 50
        "few_words": (" ".join(words(3) * 8 + words(1)), " ".join(words(3) * 8 + words(2))),  # 3 of 25
        "bars": ("a|b c d e", "a|b c d|e"),  # 1 of 5
    }
    texts = [t for pair in on.values() for t in pair]
    found = {r.doc_id: r for r in Q.verdicts(documents(spark, list(enumerate(texts)))).collect()}
    for i, name in enumerate(on):
        rule = next(r for r in Q.RULES if r.name == name)
        kept, broken = found[2 * i], found[2 * i + 1]
        assert kept[rule.statistic] in (rule.least, rule.most), name
        assert name not in kept.broken_rules.split(","), name
        assert name in broken.broken_rules.split(","), name


@pytest.mark.parametrize(
    "text",
    [
        "Он сказал, что это было не так, как она думала, и что они из города ушли на север, где по утрам было холодно и тихо, а вечером все говорили о море, за которым лежали другие земли и города.",
        "Nie wiem, czy to jest prawda, ale mówi się, że stary młyn na rzece przez wiele lat stał pusty, jak gdyby nikt go nie chciał, aż wreszcie przyszli ludzie z miasta i zaczęli od nowa budować dom.",
        "Il vecchio mulino che stava sul fiume non era più abitato da anni, ma la gente del paese diceva che di notte una luce si vedeva dalle finestre, e per questo nessuno ci voleva andare da solo.",
    ],
)
def test_prose_of_other_languages_is_kept(spark, text):
    assert Q.verdicts(documents(spark, [(1, text)])).first().broken_rules == ""


def test_sql_agrees_on_hard_texts(spark):
    import duckdb

    long = " ".join(f"word{i * i % 3989} of the" for i in range(9000))
    texts = [t for t in TEXTS if t is not None] + [long, "\n\n\n".join(f"{PROSE} {i}." for i in range(6)), "\r\n\r\n".join([PROSE] * 5), " \n\t\n" * 4 + PROSE]
    docs = documents(spark, list(enumerate(texts)))
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    sql = {r[0]: r for r in db.execute(f"SELECT doc_id, broken_rules, is_kept, n_words, repeat_line_ratio FROM ({Q.ORACLE})").fetchall()}
    for r in Q.verdicts(docs).collect():
        assert sql[r.doc_id] == (r.doc_id, r.broken_rules, r.is_kept, r.n_words, pytest.approx(r.repeat_line_ratio))
