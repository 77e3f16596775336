import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import stuffing

PROSE = [
    "We talked about the plan for the next week and it was clear that the team would need more time to finish.",
    "The report that you sent to us on Monday is in the folder, but the figures of the last year are not in it.",
    "If you have any question about this, please write to me or to one of the colleagues in the office.",
    "Der Bericht liegt auf dem Tisch, aber wir haben ihn noch nicht gelesen, weil die Zeit nicht gereicht hat.",
    "Nous avons parlé de la réunion avec les collègues et il n'est pas sûr que tout soit prêt pour lundi.",
    "Hemos hablado de la lista con el equipo y no es seguro que todo sea para el lunes por la mañana.",
]
ITEMS = ["red lamp", "garden chair", "wool coat", "steel pan", "blue kettle"]


def keywords(rng):
    return " ".join(f"{rng.choice(['buy', 'cheap', 'best'])} {x} {rng.choice(['sale', 'online'])}" for x in rng.choices(ITEMS[:3], k=60))


def links(rng):
    return "\n".join(f"- http://www.shop{rng.randrange(999)}.example/p/{rng.randrange(9999)}" for _ in range(25))


def tags(rng):
    return "\n".join(f"[{rng.choice(ITEMS)} sale](http://a{rng.randrange(99)}.example/x) " + " ".join(f"#{x.replace(' ', '')}" for x in rng.choices(ITEMS[:2], k=4)) for _ in range(15))


def menu(rng):
    return "<table>" + "".join(f"<tr><td>{rng.choice(ITEMS)}</td><td>SKU-{rng.randrange(99999):05d}</td><td><a href='http://s.example/{rng.randrange(999)}'>buy</a></td></tr>" for _ in range(20)) + "</table>"


POLISH = [
    "Raport leży na stole, ale nie został jeszcze przeczytany, bo nie było na to czasu w tym tygodniu.",
    "Jeśli masz pytania do tego planu, napisz do mnie albo do kogoś z biura, a my się tym zajmiemy.",
    "Nie jest pewne, że to się uda, ale zespół jest gotowy i będzie nad tym pracował do piątku.",
    "W raporcie jest mowa o tym, że w magazynie nie ma już miejsca i że trzeba je zrobić od nowa.",
]
DUTCH = [
    "Het verslag ligt op de tafel, maar we hebben het nog niet gelezen omdat er geen tijd voor was.",
    "Als je een vraag hebt over dit plan, schrijf dan aan mij of aan een van de mensen op het kantoor.",
    "Het is niet zeker dat het lukt, maar de ploeg is klaar en zal er tot vrijdag aan werken.",
    "In het verslag staat dat er in het magazijn geen plaats meer is en dat we die opnieuw moeten maken.",
]


def mail(body, html=False):
    return f"From: a@b.example\nContent-Type: text/{'html' if html else 'plain'}\n\n{body}"


def prose(rng, n=8):
    return "Hello all,\n\n" + "\n".join(rng.choices(PROSE, k=n)) + "\n\nKind regards,\nAnna\n-- \nAnna Example\n12 Some Lane, 06372 Town"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    docs = []
    for i in range(300):
        docs.append((i, mail(prose(rng)), False))
    table = "\n".join(f"name{i}   {i * 7}.{i}  {i * 13}" for i in range(30))
    docs.append((400, mail(prose(rng, 2) + "\n" + table), False))
    docs.append((401, mail(prose(rng, 2) + "\n" + "\n".join("> " + x for x in keywords(rng).split("sale"))), False))
    docs.append((402, mail(prose(rng) + "\n" + "\n".join(links(rng).split("\n")[:4])), False))
    for k, (make, html) in enumerate(((keywords, False), (links, False), (tags, False), (menu, True)) * 5):
        docs.append((500 + k, mail("Hi,\n" + make(rng), html), True))
    docs.append((600, mail("<p>One line here is fine, as it is for us.</p><div style='display:none'>" + keywords(rng) + "</div>", True), True))
    return docs


def test_pages_are_told_apart(spark, corpus):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t, _ in corpus] + [(900, None, 1, 2), (901, "", 1, 2), (902, "A: b\n\n...", 1, 2)], "doc_id bigint, text string, prose int, n_words int").repartition(4)
    model = stuffing.train(df, docs=200)
    shares = stuffing.line_shares(df, model)
    got = {r["doc_id"] for r in stuffing.flagged(shares).collect()}
    assert got == {d for d, _, bad in corpus if bad}
    zero = {r["doc_id"]: r for r in shares.collect()}
    assert all(zero[d]["n_words"] == 0 for d in (900, 901, 902)) and len(zero) == df.count()
    kinds = {r["doc_id"]: r for r in shares.where("doc_id >= 500").collect()}
    assert kinds[501]["links"] > kinds[501]["n_words"] / 2 and kinds[500]["tags"] > kinds[500]["n_words"] / 2
    assert stuffing.line_shares(df.limit(0), model).count() == 0
    assert stuffing.train(df.limit(0)).start.tolist() == pytest.approx(stuffing.fit([]).start.tolist())


def test_languages_that_no_list_has(spark):
    """Prose that says the same over and over, in languages with no words of their own in the code, among stuffed pages of theirs."""
    rng = random.Random(9)
    docs = [(i, mail(prose(rng)), "en-GB" if i % 2 else "EN", False) for i in range(200)]
    for base, lang, lines in ((1000, "pl", POLISH), (2000, "nl", DUTCH)):
        docs += [(base + i, mail("\n".join(rng.choices(lines, k=8))), lang if i % 9 else None, False) for i in range(100)]
        docs += [(base + 500 + i, mail("\n".join(lines * 12)), lang, False) for i in range(5)]
        stuffed = lambda: " ".join(f"{rng.choice(['tani', 'kup', 'goed', 'koop'])} {rng.choice(['dywan', 'lampa', 'stoel', 'kast'])} {rng.choice(['sklep', 'winkel'])}" for _ in range(60))
        docs += [(base + 900 + i, mail(stuffed()), lang, True) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, bad boolean").repartition(4)
    model = stuffing.train(df, lang="lang")
    assert {"nie", "że", "het", "dat", "the"} <= model.common and not {"lampa", "winkel"} & model.common
    got = {r["doc_id"] for r in stuffing.flagged(stuffing.line_shares(df, model)).collect()}
    assert got == {d for d, _, _, bad in docs if bad}
    assert stuffing.function_words(df.limit(0), lang="lang") == frozenset() == stuffing.function_words(df.limit(20))


def test_words_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(stuffing, "LEAST_DOCS", 1)
    docs = [(i, "A: b\n\n" + " ".join(["das"] * (i % 10 < 7) + ["und"] * (i % 10 < 2) + [f"x{i}", "7"])) for i in range(400)]
    for parts in (1, 6):
        df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
        assert stuffing.function_words(df) == {"das"}


def test_viterbi_against_all_paths():
    import itertools

    model = stuffing.prior()
    e, label = model.emission(), stuffing.Labeller(model)
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = rng.integers(0, stuffing.N_SYMBOLS, 5).tolist()

        def score(path):
            p = model.start[path[0]] * e[path[0], x[0]]
            for a, b, s in zip(path, path[1:], x[1:], strict=False):
                p *= model.move[a, b] * e[b, s]
            return p

        best = max(score(p) for p in itertools.product(range(len(stuffing.HIDDEN)), repeat=5))
        assert score(label.states([np.array(x)])[0]) == pytest.approx(best)
    assert label.states([]) == []
    many = [rng.integers(0, stuffing.N_SYMBOLS, n).astype(np.uint16) for n in (3, 0, 40, 1, 7, 7, 0, 300)]
    for x, got in zip(many, label.states(many), strict=True):
        assert got.tolist() == label.states([x])[0].tolist() and len(got) == len(x)


def test_fitting_raises_the_likelihood():
    rng = np.random.default_rng(2)
    seqs = [rng.choice([0, 53, 107, 161], 20).astype(np.uint16) for _ in range(200)]

    def likelihood(model):
        e, total = model.emission(), 0.0
        for x in seqs:
            a = model.start * e[:, x[0]]
            for s in x[1:]:
                total += np.log(a.sum())
                a = (a / a.sum()) @ model.move * e[:, s]
            total += np.log(a.sum())
        return total

    assert likelihood(stuffing.fit(seqs, 6)) > likelihood(stuffing.prior())
    for part in (stuffing.fit(seqs).start, *stuffing.fit(seqs).features, stuffing.fit(seqs).move):
        assert np.allclose(part.sum(-1), 1)


def test_model_of_all_rows_whatever_their_order(spark):
    rng = random.Random(4)
    docs = [(7, mail(prose(rng, 3)))] * 30 + [(i, mail(links(rng) if i % 9 == 0 else prose(rng, 3))) for i in range(300)]
    digest = "Content-Type: multipart/digest; boundary=b\n\n" + "".join(f"--b\n\n{PROSE[i % 6]}\n" for i in range(9000)) + "--b--"
    docs += [(10_000 + i, mail(rng.choice(PROSE))) for i in range(8100)] + [(9999, digest)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    common = stuffing.function_words(df)
    seqs = [np.array([x.symbol for x in got], np.uint16) for _, t in docs for lines in stuffing.mailtext.own_lines(t) if (got := stuffing.part_lines(lines, common))]
    want = stuffing.fit(seqs, docs=len(docs))
    for parts in (1, 5):
        got = stuffing.train(df.orderBy(F.rand(parts)).repartition(parts))
        for a, b in zip((got.start, got.move, *got.features), (want.start, want.move, *want.features), strict=True):
            assert a.tolist() == b.tolist()
    many = stuffing.expected(want, seqs)
    assert (many == sum(stuffing.expected(want, seqs[i : i + 7000]) for i in range(0, len(seqs), 7000))).all()
    assert many[: len(stuffing.HIDDEN)].sum() / stuffing.UNIT == pytest.approx(len(seqs), rel=1e-3)


def test_long_lines_come_in_pieces():
    words = " ".join(f"w{i}" for i in range(100))
    got = stuffing.part_lines([words, "", "http://a.example/b", "...", words + " http://a.example/b " + words])
    assert sum(x.words for x in got) == 100 + 4 + 204 and max(x.words for x in got) <= 16
