"""What reaches the driver, and what the native operators are made of."""

import os
import re

from creditloom import llm

FOLDER = os.path.dirname(llm.__file__)
NATIVE = ("winnow.py", "chat.py", "mixing.py")


def sources():
    for name in sorted(os.listdir(FOLDER)):
        if name.endswith(".py"):
            yield name, open(os.path.join(FOLDER, name), encoding="utf-8").read()


def test_bounded_results_only_reach_the_driver():
    allowed = {
        "kneser_ney.py": 1,  # a row of totals per shard
        "quality.py": 2,  # normal equations per fold, cells of the score grid
        "suffixes.py": 1,  # numbers of the tasks
        "urls.py": 1,  # a sample that places the cuts
        "vector_codes.py": 2,  # the first entries, sums per entry and component
    }
    found = {}
    for name, text in sources():
        n = len(re.findall(r"\.(?:collect|toPandas|toLocalIterator|toArrow)\(", text))
        if n:
            found[name] = n
        assert "localCheckpoint" not in text and "crossJoin" not in text
    assert found == allowed


def test_native_operators_have_no_python_in_tasks():
    for name, text in sources():
        if name in NATIVE:
            assert not re.search(r"mapIn|applyIn|udf|\.rdd|import (numpy|pandas|pyarrow)", text), name
