import random
from itertools import combinations

import numpy as np
import pytest

from quern.llm import languages
from quern.llm.languages import fit, learn
from quern.llm.neardup import minhash_keys
from quern.llm.pairs import _hashes, _shingles, band_links, broken_pairs, normal, read_answer, read_pair

PROMPT = (
    "Read the passage and list every step that a software project can act on.\n\nPassage: Maintainers should review the build scripts before each release. "
    "The team of the project has to keep the old branches alive, and it is useful for users that want to upgrade later."
)
REC = "{'recommendations': [{'recommendation': \"Review the project's scripts before each release.\", 'positive_impact': 'It is safer for the users.', 'evidence': 'NO EVIDENCE FOUND', 'confidence': %s}]}"
CASES = [
    (None, "empty"), ("", "empty"), (" \n\xa0", "empty"), ("nan", "empty"), ("...", "empty"), ("```json\n```", "empty"), ('""', "empty"), ("{'recommendations': [{}]}", "empty"),
    ("{'recommendations': [{'recommendation': '', 'positive_impact': 'NO IMPACT FOUND', 'confidence': 0.5}]}", "empty"),
    (REC % "nan", None), (REC % "'high'", None), ("```json\n" + (REC % 1).replace("\"", "'").replace("project's", "project") + "\n```", None),
    ("{'message': 'NO ACTIONABLE CAN BE DERIVED'}", None), ("NO ACTIONABLE CAN BE DERIVED", None),
    ("1. Review scripts. (It is safe.)\n2. Keep the branches. (It is safe.)", None),
    ("Maintainers should review the build scripts before each release.", None),
    ("{'recommendations': [{'recommendation': 'Tell users that the team cannot help with private setups.', 'evidence': 'NO EVIDENCE FOUND'}]}", None),
    ((REC % 1)[:-40], "truncated"), ((REC % 1)[:-3], "truncated"), ("{'recommendations': [{'recommendation'", "truncated"),
    ("{'recommendations': [{'recommendation': 'Review all of the scripts before each rel', 'confidence': 1}]}", "truncated"),
    ("1. Review scripts. (It is safe.)\n2. Keep the branches and the", "truncated"),
    (PROMPT, "copied"), ("> " + PROMPT.upper(), "copied"), (PROMPT[:260], "copied"), ("{'message': %r}" % PROMPT, "copied"),
    ("{'recommendations': [{'recommendation': 'Review the scripts.', 'evidence': 'NO EV'}]}", "truncated"),
    ("['Use checks', 'Write notes']", None), ("['Use checks.', 'Write no']", "truncated"),
]


@pytest.mark.parametrize("answer,defect", CASES)
def test_defects(answer, defect):
    assert read_pair(PROMPT, answer, 0.6).defect == defect


def test_short_prompts_and_every_window():
    assert read_pair("Say yes", "Say yes!", 0.6).defect == "copied" and read_pair("Say yes", "I say yes to it.", 0.6).defect is None
    words = PROMPT.split()
    for k in range(6):  # wherever the copy begins
        assert read_pair(PROMPT, " ".join(words[k : k + 38]) + ".", 0.6).defect == "copied"
    assert read_pair(PROMPT, " ".join(words[:20]) + ".", 0.6).defect is None


def test_escapes_and_long_answers():
    assert read_answer(r"""{"message": "a\nb \u00e9 \"q\""}""")[0] == ['a\nb é "q"']
    assert read_pair("", "x " * 300_000 + ".", 0.6).defect is None and read_pair(None, "Fine text.", 0.6).defect is None


def test_statements():
    r = read_pair(PROMPT, "Sorry, it stays out of reach here; ask others.\n1. Review scripts.", 0.6)
    assert r.advises and not r.bare and r.clauses == ["sorry", "it stays out of reach here", "ask others"] and r.weights == [1, 6, 2]
    assert read_pair(PROMPT, "{'message': 'It stays.', 'error': 'Out of reach.'}", 0.6).bare
    assert not read_pair(PROMPT, REC % 1, 0.6).bare
    # what stands in the prompt is no clause
    assert read_pair(PROMPT, "Maintainers should review the build scripts before each release.", 0.6).clauses == []


WORDS = {
    "en": "the team should review every change before it is merged and write down why old branches are kept when users still need them for their work with other tools that have not been replaced",
    "de": "das team sollte jede änderung prüfen bevor sie übernommen wird und aufschreiben warum alte zweige bleiben wenn nutzer sie noch für ihre arbeit mit anderen werkzeugen brauchen die nicht ersetzt wurden",
    "es": "el equipo debería revisar cada cambio antes de integrarlo y anotar por qué se mantienen las ramas antiguas cuando los usuarios todavía las necesitan para su trabajo con otras herramientas que no se han sustituido",
    "it": "il gruppo dovrebbe rivedere ogni modifica prima di accettarla e scrivere perché i rami vecchi restano quando gli utenti ne hanno ancora bisogno per il loro lavoro con altri strumenti che non sono stati sostituiti",
}


def test_languages():
    rng = random.Random(5)
    draw = lambda x, n=60: normal(" ".join(rng.choices(WORDS[x].split(), k=n)))
    told = fit([draw(x) for x in ("en",) * 60 + ("de", "es") * 12])
    assert len(told.logs) == 3
    prompts = [draw(x) for x in ("en", "en", "en", "de", "de", "es", "en")] + [draw("en")] * 3
    answers = [draw(x) for x in ("en", "de", "it", "de", "en", "es")] + [draw("es", 8), "Команда должна проверять изменения", "チームは変更を確認する", "42 7"]
    assert told.differ(prompts, answers, 20.0).tolist() == [False, True, True, False, True, False, True, True, True, False]
    # unusual words of the prompt's own language are no other one, where few of its words are known; a strange text is, where many are
    strange = normal(" ".join(rng.choices("wrzyj kłopot źdźbło pszczoła gżegżółka szczęście".split(), k=30)))
    few = fit([draw("en") for _ in range(40)])
    assert few.types[0] < 2500 and few.differ([draw("en")] * 2, [normal("keep a list of such owners and name two for each module of it"), strange], 20.0).tolist() == [False, False]
    few.types[:] = 2500
    assert few.differ([draw("en")] * 2, [draw("en"), strange], 20.0).tolist() == [False, True]
    assert not fit([]).differ(["a b"], ["c d"], 20.0).any()


def test_rare_language_of_a_large_table(spark):
    """Ten texts in 24,000 make a language: all are learned from, so answers in it are told from English prompts."""
    rng = random.Random(11)
    draw = lambda x, n=24: " ".join(rng.choices(WORDS[x].split(), k=n)) + "."
    rows = [(i, draw("en", 32), draw("en")) for i in range(12_000)]
    rows += [(20_000 + i, draw("de", 32), draw("de", 32)) for i in range(5)] + [(30_000 + i, draw("en", 32), draw("de", 32)) for i in range(3)] + [(40_000 + i, draw("de", 32), draw("en")) for i in range(3)]
    df = spark.createDataFrame(rows, "response_id long, prompt string, answer string").repartition(4)
    found = {(r.response_id, r.defect) for r in broken_pairs(df).collect()}
    assert found == {(30_000 + i, "language") for i in range(3)} | {(40_000 + i, "language") for i in range(3)}


def test_languages_learned_level_by_level(spark, monkeypatch):
    """However the texts are dealt and folded, all of them are counted, repeated ones once."""
    rng = random.Random(7)
    texts = [normal(" ".join(rng.choices(WORDS[x].split(), k=40))) for x in ("en",) * 400 + ("de",) * 60 + ("es",) * 30]
    df = spark.createDataFrame([(t,) for t in texts + texts[:50]], "t string").selectExpr("xxhash64(t) as h", "t")
    whole, order = fit(texts), lambda x: np.argsort(-x.types)
    for task, fan, parts in ((16_000, 16, 1), (60, 2, 3), (60, 2, 5)):
        monkeypatch.setattr(languages, "_TASK", task)
        monkeypatch.setattr(languages, "_FAN", fan)
        told = learn(df.repartition(parts))
        assert len(told.logs) == 3 and np.allclose(told.logs[order(told)], whole.logs[order(whole)])
    assert not len(learn(df.limit(0)).logs)


def test_forms_that_recur_are_no_language():
    """Short texts in few other words of a language belong to it, not to the most frequent one."""
    rng = random.Random(9)
    draw = lambda x, n=60: normal(" ".join(rng.choices(WORDS[x].split(), k=n)))
    form = "leider darf ich dazu nichts sagen bitte stellen sie eine andere frage an das team wenn sie noch hilfe brauchen und nutzer sind"
    told = fit([draw("en") for _ in range(400)] + [draw("de") for _ in range(60)] + [f"{form} {k}" for k in ("heute", "morgen", "später", "danach")])
    assert len(told.logs) == 2
    assert told.differ([draw("de"), draw("en")], [form, form], 20.0).tolist() == [False, True]


def advice(k, text="Tell the users that the team cannot help with private setups."):
    return "{'recommendations': [{'recommendation': %r, 'positive_impact': 'It is safer for group %d.', 'evidence': 'NO EVIDENCE FOUND'}]}" % (text, k)


def test_templates_across_prompts(spark):
    """Refusals in words that no list holds; advice that recurs with its records, and what one prompt's answers share, is sound."""
    odd = "Such material stays with its authors"
    tail = "and the service may comment on none of it here"
    asked = lambda k: f"Please read text number {k} of the collection that lies before you and list what to do"
    rows = [(i, asked(i), f"{lead}{odd}, {tail}.") for i, lead in enumerate(["", "Sorry, ", "Regrettably ", "Well then, "])]
    rows += [(10 + i, asked(i), form % f"{odd}, {tail}.") for i, form in enumerate(["{'message': '%s'}", "{\"error\": \"%s\"}", "{'recommendations': [{'recommendation': '%s', 'positive_impact': 'NO IMPACT FOUND'}]}"])]
    rows += [(20, asked(20), "Questo servizio non risponde."), (21, asked(21), "Questo servizio non risponde!"), (22, asked(22), "{'message': 'Questo servizio non risponde.'}")]
    rows += [(30 + i, asked(i), advice(i)) for i in range(8)] + [(38, asked(8), "Tell the users that the team cannot help with private setups.")]
    rows += [(50 + i, asked(50), "Only this prompt gets such a reply from the model.") for i in range(8)]
    rows += [(60, asked(60), f"{odd}, {tail}.\n1. Review the scripts. (It is safe.)\n2. Keep the old branches. (It is safe.)")]
    rows += [(61 + i, asked(i), "NO ACTIONABLE CAN BE DERIVED") for i in range(8)]
    rows += [(90, PROMPT, REC % 1), (91, None, None), (None, PROMPT, None), (90, PROMPT, "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "response_id long, prompt string, answer string, defect string, clauses string").repartition(3)
    found = {(r.response_id, r.defect) for r in broken_pairs(df).collect()}
    refused = {i for i, d in found if d == "refusal"}
    assert {(90, "empty"), (91, "empty")} <= found and len(found) == 2 + len(refused)
    assert refused == set(range(4)) | {10, 11, 12, 20, 21, 22}
    assert broken_pairs(df.limit(0)).count() == 0


def test_clause_links_against_brute_force():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    clauses = []
    for _ in range(600):
        base = list(rng.choice(clauses).split()) if clauses and rng.random() < 0.7 else rng.choices(words, k=rng.randint(6, 30))
        if rng.random() < 0.6:
            base[rng.choice([0, -1])] = rng.choice(words)
        clauses.append(" ".join(base))
    clauses = list(dict.fromkeys(clauses))
    sets = [set(_shingles(c)) for c in clauses]
    wanted = {(i, j) for i, j in combinations(range(len(clauses)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    offsets, values = _hashes(clauses)
    key = minhash_keys(offsets, values, 12, 3)
    at = np.argsort(key.ravel(), kind="stable")
    of = np.repeat(np.arange(len(clauses)), 12)[at]
    size = np.diff(offsets)[of]
    links = band_links(key.ravel()[at], of, np.concatenate(([0], np.cumsum(size))), np.concatenate([values[offsets[i] : offsets[i + 1]] for i in of]), 0.8)
    found = {(min(a, b), max(a, b)) for a, b in links.tolist()}
    assert len(wanted) > 100 and found <= wanted and len(found) >= 0.99 * len(wanted)
