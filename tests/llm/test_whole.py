"""Links of crowded bands, scripts, and refusals of any length, against brute force on small tables."""

import random

import numpy as np
import pytest

from quern.llm.languages import other_script
from quern.llm.neardup import minhash_keys
from quern.llm.pairs import _hashes, _verified, band_links, broken_pairs

LONG = "I am sorry about this request.\nI can't help with the passage, since " + "it holds material of a kind that the service leaves alone and " * 6 + "that stays so.\nI would be glad to read another one with you."
EVIDENCE = "{'recommendations': [{'recommendation': 'Split the large modules.', 'positive_impact': 'Reviews are faster.', 'evidence': \"I can't review files of this size, said a maintainer.\"}]}"
TWO = "{'recommendations': [{'recommendation': 'It holds material that the service leaves alone.', 'positive_impact': 'No one is harmed by it.', 'evidence': 'The passage.'}]}"


def test_long_refusals_come_out(spark):
    asked = lambda k: f"a prompt number {k} of some words"
    rows = [(k, asked(k), LONG) for k in range(4)] + [(10 + k, asked(k), EVIDENCE) for k in range(4)]
    # one with a second text, of a template that is bare elsewhere
    rows += [(20 + k, asked(k), "It holds material that the service leaves alone.") for k in range(6)] + [(30, asked(1), TWO)]
    df = spark.createDataFrame(rows, "response_id long, prompt string, answer string")
    assert sorted(tuple(r) for r in broken_pairs(df).collect()) == [(i, "refusal") for i in (0, 1, 2, 3, 20, 21, 22, 23, 24, 25, 30)]


def _clusters(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for x, y in pairs:
        root[max(top(x), top(y))] = min(top(x), top(y))
    return {x: top(x) for x in root}


@pytest.mark.parametrize("crowd", [4096, 100])
def test_crowded_bands_lose_no_link(spark, crowd):
    rng = random.Random(8)
    lead = " ".join(f"lead{k}" for k in range(14))
    openings = [f"{lead} a{i} b{i}" for i in range(500)]  # similarity 10/14 to one another
    openings += [f"{lead} a{i} c{i}" for i in range(60)]  # 11/13 to the opening of the same a
    openings += [f"{lead} t x{i}" for i in range(150)]  # a template, 11/13 to one another
    rng.shuffle(openings)
    offsets, values = _hashes(openings)
    sets = [set(values[offsets[k] : offsets[k + 1]].tolist()) for k in range(len(openings))]
    key = minhash_keys(offsets, values, 12, 3).view(np.int64)
    meet = {}
    for k in range(len(openings)):
        for x in key[k].tolist():
            meet.setdefault(x, []).append(k)
    pairs = {(x, y) for m in meet.values() for n, x in enumerate(m) for y in m[n + 1 :]}
    expected = _clusters((x, y) for x, y in pairs if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]))
    assert len(expected) > 260
    banded = spark.createDataFrame([(x, k, values[offsets[k] : offsets[k + 1]].view(np.int64).tolist()) for k in range(len(openings)) for x in key[k].tolist()], "key long, oid long, s array<long>").repartition(3)
    found = [tuple(r) for r in _verified(banded, 0.8, crowd).collect()]
    assert all(len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) for x, y in found)
    assert _clusters(found) == expected
    assert band_links(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([0, 1]), np.ones(1, np.uint64), 0.8).shape == (0, 2)


@pytest.mark.parametrize("prompt,answer,defect", [
    ("List every step for the project.", "Проверяйте скрипты.", "language"),
    ("List every step for the project.", "راجع البرامج.", "language"),
    ("List every step for the project.", "스크립트를 검토하세요.", "language"),
    ("List every step for the project.", "スクリプトを確認してください。", "language"),
    ("列出项目的所有步骤。", "スクリプトを確認してください。", "language"),
    ("Перечислите все шаги проекта.", "Review every build script before each release.", "language"),
    ("Перечислите все шаги проекта.", "Проверяйте README.md и CONTRIBUTING.", None),
    ("Перечислите все шаги проекта.", "README.md", None),
    ("列出项目的所有步骤。", "检查脚本。", None),
    ("List every step for the project.", "Name André and Zoë owners (α, β).", None),
])
def test_scripts_tell_languages(prompt, answer, defect):
    assert other_script(prompt.lower(), answer.lower()) == (defect == "language")
