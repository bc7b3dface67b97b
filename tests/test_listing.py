"""Folder trees listed level by level."""

import os
import random

import pytest

from sparkloom.sources.listing import list_tree, read_named_texts
from sparkloom.sources.tables import list_files


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    """Some hundred files up to six levels deep, empty and hidden ones among them."""
    root, rng, want = tmp_path_factory.mktemp("tree"), random.Random(4), {}
    folders = [""]
    for i in range(60):
        folders.append(f"{rng.choice(folders)}/d{i}".lstrip("/"))
        os.makedirs(root / folders[-1])
    for i in range(400):
        name, n = f"{rng.choice(folders)}/f {i}.é".lstrip("/"), rng.randrange(4) * 7
        (root / name).write_text("x" * n)
        want[name] = n
    for hidden in ("_SUCCESS", ".x.crc", "d0/_temporary"):
        (root / hidden).write_text("no")
    return str(root), want


def names(rows, root):
    return {r["path"].removeprefix(f"file:{root}/"): r["length"] for r in rows}


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}/"])
def test_tree(spark, tree, form):
    root, want = tree
    rows = list_tree(spark, form.format(root)).collect()
    assert names(rows, root) == want if "//" not in form else len(rows) == len(want)
    assert all(r["modified"] is not None for r in rows)


def test_one_folder(spark, tree):
    root, want = tree
    rows = list_files(spark, root).collect()
    assert names(rows, root) == {k: n for k, n in want.items() if "/" not in k}
    assert names(list_files(spark, root, recursive=True).collect(), root) == want


def test_contents(spark, tree):
    root, want = tree
    assert {r["name"]: len(r["content"]) for r in read_named_texts(spark, f"file:{root}").collect()} == want


def test_empty_and_missing(spark, tmp_path):
    assert list_tree(spark, str(tmp_path)).count() == 0 and read_named_texts(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        list_tree(spark, f"{tmp_path}/none")
