"""The two classification tasks and their label vocabularies."""

from __future__ import annotations

from dataclasses import dataclass

# Label names and ids of the two tasks.
HATE_SPEECH_LABELS = {"hate": 0, "abusive": 1, "normal": 2, "offensive": 1}
FAKE_NEWS_LABELS = {"fake": 0, "real": 1}


@dataclass(frozen=True)
class Task:
    """One classification task.

    ``labels`` lists the canonical name of each id in id order; ``aliases``
    holds every accepted spelling, so several spellings may share an id.
    """

    name: str
    labels: tuple[str, ...]
    aliases: dict[str, int]
    max_length: int
    selection_metric: str

    @property
    def ids(self) -> tuple[int, ...]:
        return tuple(range(len(self.labels)))


HARM = Task("hate_speech", ("hate", "abusive", "normal"), HATE_SPEECH_LABELS, 128, "f1_macro")
VERACITY = Task("fake_news", ("fake", "real"), FAKE_NEWS_LABELS, 256, "f1_binary")

_TASKS = {task.name: task for task in (HARM, VERACITY)}


def get_task(task: str | Task) -> Task:
    """Resolve a task by name; an unknown name is an error, never a default."""
    if isinstance(task, Task):
        return task
    try:
        return _TASKS[task]
    except KeyError:
        raise ValueError(f"unknown task {task!r}; expected one of {sorted(_TASKS)}") from None
