"""Label encoding and decoding as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from civitext.tasks import Task, get_task

# The white space characters stripped from the ends of a label.
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _lookup(pairs, key: Column) -> Column:
    table = F.create_map(*(F.lit(item) for item in chain.from_iterable(pairs)))
    return F.try_element_at(table, key)


def clean(label: Column) -> Column:
    """A label in lower case without white space at its ends."""
    return F.btrim(F.lower(label), F.lit(_BLANKS))


def encode(label: Column, task: str | Task) -> Column:
    """Integer id of a label; NULL when the label is unknown or NULL."""
    return _lookup(get_task(task).aliases.items(), clean(label)).cast("int")


def decode(label_id: Column, task: str | Task) -> Column:
    """Canonical name of a label id."""
    return _lookup(enumerate(get_task(task).labels), label_id.cast("int"))
