"""Pseudonyms of dates in every written form."""

import re
from datetime import date, timedelta

import pytest

from docsheaf.llm.pii import FIRST_DAY, LAST_DAY, pseudonymise

KEY = b"a key for these tests only"
FORMS = ["{y}-{m:02}-{d:02}", "{y}-{m}-{d}", "{y}/{m:02}/{d:02}", "{m:02}/{d:02}/{y}", "{d:02}/{m:02}/{y}", "{m}/{d}/{y}", "{d}/{m}/{y}", "{d:02}.{m:02}.{y}", "{d}.{m}.{y}", "{d}.{m:02}.{y}"]


def written(form):
    day = FIRST_DAY
    while day <= LAST_DAY:
        yield form.format(y=day.year, m=day.month, d=day.day)
        day += timedelta(1)


@pytest.fixture(scope="module")
def texts():
    """Every text that some form gives, with its pseudonym."""
    return {t: pseudonymise(t, KEY)[0] for t in {t for f in FORMS for t in written(f)}}


def test_no_two_dates_become_the_same(texts):
    assert len(set(texts.values())) == len(texts) > 300_000


def test_forms_are_kept(texts):
    shape = lambda t: re.sub("[0-9]", "0", t)
    assert all(shape(t) == shape(n) for t, n in texts.items())
    # What can only be day first stays so, and what reads as month first too.
    first = lambda t: int(t.split("/")[0]) > 12
    assert all(first(t) == first(n) for t, n in texts.items() if t[2:3] == "/" or t[1:2] == "/")


def test_equal_days_are_linked_across_forms_that_hold_every_day(texts):
    for day in (date(1900, 1, 1), date(1999, 12, 31), date(2024, 2, 29)):
        new = {texts[f.format(y=day.year, m=day.month, d=day.day)] for f in (FORMS[0], FORMS[3], FORMS[7])}
        days = {(p[0], p[1], p[2]) if len(p[0]) == 4 else (p[2], p[0], p[1]) if "/" in t else (p[2], p[1], p[0]) for t in new for p in [re.split("[-/.]", t)]}
        assert len(days) == 1
    assert pseudonymise("31/02/2020 and 2020-13-01", KEY)[1] == []
