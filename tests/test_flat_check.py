"""The flat check of a schema accepts only what the rules, asked one by one, accept."""

import json
import random

import pytest
from golden import GOLDEN, LARGE

from tracewright import schemas
from tracewright.operators import contracts

ODD = [None, True, 0, -1, 1, 1.0, 1.5, 10**9, 10**400, float("nan"), float("inf"), "", "x", "x" * 101, "𝒳" * 60, "x" * 2001, [], [1], {}, {"a": 1}]


def places(value):
    """Every (container, key) of a parsed value."""
    for k in list(value) if isinstance(value, dict) else range(len(value)):
        yield value, k
        if isinstance(value[k], dict | list):
            yield from places(value[k])


@pytest.mark.parametrize("whole", [GOLDEN, LARGE], ids=["golden", "large"])
def test_the_flat_check_never_accepts_what_has_errors(whole):
    fits, chance = schemas.fitting(schemas.REQUEST), random.Random(7)
    assert fits(json.loads(json.dumps(whole)))
    for _ in range(400):
        value = json.loads(json.dumps(whole))
        at, k = chance.choice(list(places(value)))
        if isinstance(at, dict) and chance.random() < 0.2:
            at["extra"] = at.pop(k) if chance.random() < 0.5 else 1
        elif isinstance(at, list) and chance.random() < 0.3:
            at.append(at[k])
        else:
            at[k] = chance.choice(ODD)
        errors = next(schemas.REQUEST.errors(value), None)
        assert fits(value) == (errors is None), errors


def test_valid_records_are_not_walked_rule_by_rule(monkeypatch):
    golden, fits = json.dumps(GOLDEN), schemas.fitting(schemas.REQUEST)
    monkeypatch.setattr(schemas.Spec, "errors", lambda *_: pytest.fail("walked"))
    assert contracts._check(golden, schemas.REQUEST, fits) == ([], json.dumps(contracts._whole(GOLDEN), ensure_ascii=False))


@pytest.mark.parametrize("number", ["2", "2.0", "2.000", "2e0", "20E-1", "0.2e1", "1.99999999999999999999"])
def test_whole_numbers_in_any_form_are_whole(number):
    spec = schemas.Number(least=1, most=9, whole=True)
    assert contracts._check(number, spec, schemas.fitting(spec)) == ([], "2")
