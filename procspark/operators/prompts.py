"""Model input text, as Column expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from procspark.functions.text import capitalize, py_list_repr, rstrip

# Prompt texts, spelling included.
PAIRS_TASK = """Given a list of activities that constitute an organizational process, determine all pairs of activities that can reasonably follow each other directly in an execution of this process."""
TREE_TASK = """Given a list of activities below that constitute an organizational process, determine the process tree of the process. A process tree is a hierarchical process model. The following operators are defined for process trees:
 -> ( A, B ) tells that process tree A should be executed before process tree B
X ( A, B ) tells that there is an exclusive choice between executing process tree A and process tree B
+ ( A, B ) tells that process tree A and process treee B are executed in true concurrency
* ( A, B ) tells that process tree A is executed, then either you exit the loop, or you execute B and then A again (this can happen several times until the loop is exited). The leafs of a process tree are either activities or silent steps (indicated by tau).
An example process tree follows:
+ ( 'a', -> ( 'b', 'c', 'd' ) )
It defines that you should execute b before executing c and c before d. In true concurrency to this, you can execute a. Therefore, the possible traces that this tree allows for are a->b->c->d, b->a->c->d, b->c->a->d, b->c->d->a.
 Provide the process tree in the format of the example as the answer.
Use only activities from the given list as leaf nodes and only the allowed operators (->, X, +) as inner nodes. Also make sure each activity is used exactly once in the tree and there and each subtree has exactly one root node, i.e., pay attention to set parentheses correctly."""
PAIRS_MARK = "Pairs of activities:\n"
TREE_MARK = "Process Tree:\n"
NEXT_QUESTION = ("Which one of the above activities should follow the below sequence of "
                 "activities?\n")
VALID_TAIL = "\n: Valid: "
MAX_LETTERS = 26


def set_repr(activities: Column) -> Column:
    """``{'a', 'b'}``: a set as Python prints it, in sorted order."""
    inner = py_list_repr(activities)
    return F.concat(F.lit("{"), F.substr(inner, F.lit(2), F.length(inner) - 2), F.lit("}"))


def _activities(activities: Column, as_set: bool) -> Column:
    return set_repr(activities) if as_set else py_list_repr(activities)


def trace_prompt(activities: Column, trace: Column, tail: bool = True, as_set: bool = False) -> Column:
    """Trace validity. ``tail=False`` is the text for a classifier head.

    Activities print as a list, which is what a set column is once stored in a
    table; ``as_set`` prints braces.
    """
    return F.concat(F.lit("Set of process activities: "), _activities(activities, as_set),
                    F.lit("\nProcess: "), py_list_repr(trace), F.lit(VALID_TAIL if tail else ""))


def pair_prompt(activities: Column, pair: Column, tail: bool = True, as_set: bool = False) -> Column:
    """Pair validity; ``pair`` is struct<src, dst>."""
    both = F.array(pair["src"], pair["dst"])
    return F.concat(F.lit("Set of activities: "), _activities(activities, as_set),
                    F.lit("\nOrdered activities: "), py_list_repr(both), F.lit(VALID_TAIL if tail else ""))


def _numbered(activities: Column) -> Column:
    lines = F.transform(activities, lambda a, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), capitalize(a), F.lit("\n")))
    return F.array_join(lines, "")


def _sequence(prefix: Column) -> Column:
    return F.concat(F.lit("Sequence of activities: "), py_list_repr(F.transform(prefix, capitalize)),
                    F.lit("\n"))


def next_activity_prompt(activities: Column, prefix: Column) -> Column:
    """Lettered menu; more activities than letters is an error."""
    lines = F.transform(activities, lambda a, i: F.concat(
        F.char(i + ord("A")), F.lit(". "), capitalize(a), F.lit("\n")))
    menu = F.when(F.size(activities) <= MAX_LETTERS, F.array_join(lines, "")).otherwise(
        F.raise_error(F.lit("more activities than letters")))
    return F.concat(F.lit("List of activites:\n0. [END]\n"), menu, F.lit(NEXT_QUESTION),
                    _sequence(prefix), F.lit("Answer: "))


def next_activity_menu(activities: Column, prefix: Column) -> Column:
    """Numbered menu for a classifier head."""
    return F.concat(F.lit("\n0. [END]\n"), _numbered(activities), _sequence(prefix))


def _generation(df: DataFrame, activities: str, task: str, mark: str, target: Column, eos: str,
                train: bool, eos_in_eval: bool) -> DataFrame:
    prompt = F.concat(F.lit(task + "\n"), _numbered(F.col(activities)), F.lit(mark))
    out = (df.withColumn("prompt", prompt)
           .withColumn("target", F.concat(target, F.lit(eos if train or eos_in_eval else ""))))
    return out.withColumn("text", F.concat("prompt", "target") if train else F.col("prompt"))


def dfg_prompt(df: DataFrame, eos: str = "", train: bool = True, task: str = PAIRS_TASK,
               activities: str = "unique_activities", dfg: str = "dfg") -> DataFrame:
    """``prompt``, ``target`` (one ``Lhs -> Rhs`` per line) and model input ``text``.

    In training ``text`` is prompt + target + EOS; in evaluation it is the prompt
    and the target stays apart, without EOS.
    """
    lines = F.transform(dfg, lambda p: F.concat(capitalize(p["src"]), F.lit(" -> "), capitalize(p["dst"])))
    return _generation(df, activities, task, PAIRS_MARK, rstrip(F.array_join(lines, "\n")), eos,
                       train, eos_in_eval=False)


def tree_prompt(df: DataFrame, eos: str = "", train: bool = True, task: str = TREE_TASK,
                activities: str = "unique_activities", tree: str = "pt") -> DataFrame:
    """As ``dfg_prompt`` with the tree text as target, which has its EOS in evaluation too."""
    return _generation(df, activities, task, TREE_MARK, rstrip(F.col(tree)), eos, train,
                       eos_in_eval=True)


def two_choice_prompt(premise: Column, question: Column, choice1: Column, choice2: Column,
                      shift: bool = True) -> Column:
    """Two-choice question; ``shift`` adds the ``0`` that the last-token label replaces."""
    return F.concat(F.lit('Premise: "'), premise, F.lit('"\nQuestion: "'), question,
                    F.lit('"\nChoice 1: "'), choice1, F.lit('"\nChoice 2: "'), choice2,
                    F.lit('"\nAnswer: 0' if shift else '"\nAnswer: '))


def strip_prompt(generated: Column, compat: bool = False) -> Column:
    """Text after the first answer mark of a generated text.

    Without any mark the text stays whole; ``compat`` cuts it at the position a
    failed search leads to (one short of the length of the pairs mark).
    """
    def after(mark: str) -> Column:
        return F.substr(generated, F.instr(generated, mark) + len(mark))

    absent = F.substr(generated, F.lit(len(PAIRS_MARK))) if compat else generated
    return (F.when(F.instr(generated, TREE_MARK) > 0, after(TREE_MARK))
            .when(F.instr(generated, PAIRS_MARK) > 0, after(PAIRS_MARK)).otherwise(absent))
