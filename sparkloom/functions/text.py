"""Column functions for names, paths and document lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: LaTeX specials in the order in which they are looked for, and
#: what stands for each (a space follows in the first-match form).
SPECIALS = (
    ("_", r"\_"),
    ("&", r"\&"),
    ("$", r"\$"),
    ("%", r"\%"),
    ("{", r"\{"),
    ("}", r"\}"),
    ("#", r"\#"),
    ("~", r"\textasciitilde"),
    ("^", r"\textasciicircum"),
    ("\\", r"\textasciibackslash"),
)
#: Codes of studies, the first one found in a name counts.
STUDY_CODES = ("NEWT", "DRM", "HIR", "FTO")
#: Grouping modes and the index list of each.
MODES = (
    ("One Image per view", ()),
    ("Show all sides of each subject per day", (1,)),
    ("Show all days of each subject per side", (2,)),
    ("Show all sides and all days for each subject", (1, 2)),
)


def clean_items(items: Column) -> Column:
    """A list without empty strings and single spaces."""
    return F.filter(items, lambda x: ~x.isin("", " "))


def first_marked(text: Column, marker: str, skip: int) -> Column:
    """The first line that holds the marker, from character ``skip`` on (counted
    from 0); null if there is none."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit(marker))), F.lit(0))
    return F.substr(line, F.lit(skip + 1))


def replace_first(name: Column, old: str, new: str) -> Column:
    """The first occurrence replaced, if there is one."""
    return F.concat_ws(new, F.split(name, r"\Q" + old + r"\E", 2))


def latex_escape(text: Column, mode: str = "first") -> Column:
    """LaTeX specials escaped.

    ``first``: only the first kind of special that occurs, each followed by a
    space. ``v3``: underscores, else degree signs, without the space. ``all``:
    every special, each once.
    """
    if mode == "v3":
        return F.when(F.contains(text, F.lit("_")), F.replace(text, F.lit("_"), F.lit(r"\_"))).otherwise(
            F.replace(text, F.lit("°"), F.lit(r"\°"))
        )
    if mode == "all":
        table = {c: s + ("{}" if s[1:].isalpha() else "") for c, s in SPECIALS} | {"\\": r"\textbackslash{}"}
        marked = F.transform(F.split(text, ""), lambda c: _looked_up(c, table))
        return F.array_join(marked, "")
    out = text
    for special, escaped in reversed(SPECIALS):
        once = F.replace(text, F.lit(special), F.lit(escaped + " "))
        out = F.when(F.contains(text, F.lit(special)), once).otherwise(out)
    return out


def _looked_up(c: Column, table: dict[str, str]) -> Column:
    out = c
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def tex_line(kind: str, head: Column, body: Column | None = None) -> Column:
    """Markup of a section, subsection, subsubsection, item or description item."""
    if kind == "item":
        return F.concat(F.lit("\t\\item "), head)
    if kind == "description":
        return F.concat(F.lit("\\item["), head, F.lit("]"), body)
    out = F.concat(F.lit("\\" + kind + "{"), head, F.lit("}"))
    return out if body is None else F.concat(out, F.lit("\n"), body)


def parent_dir(path: Column, sep: str = "/", join: str = "\\") -> Column:
    """The folders of a path, without the file name."""
    parts = F.split(path, sep)
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), join)


def type_glob(name: Column) -> Column:
    """``*`` and the last four characters of the name."""
    return F.concat(F.lit("*"), F.right(name, F.lit(4)))


def study_code(name: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(name, F.lit(c)), F.lit(c)) for c in STUDY_CODES))


def mode_index(mode: Column) -> Column:
    """Index list of a grouping mode; null for an unknown one."""
    out = F.lit(None).cast("array<int>")
    for name, index in MODES:
        out = F.when(mode == name, F.array(*(F.lit(i) for i in index)).cast("array<int>")).otherwise(out)
    return out
