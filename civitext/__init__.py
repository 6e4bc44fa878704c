"""Text-safety analytics as Spark DataFrame jobs.

Sub-packages: ``functions`` (Column -> Column), ``sources`` (readers and
writers), ``operators`` (DataFrame -> DataFrame), ``streaming`` (scoring of
streams) and ``plans`` (the registered queries and their SQL oracles).
"""

from civitext.tasks import HARM, VERACITY, Task, get_task

__all__ = ["HARM", "VERACITY", "Task", "get_task"]
