"""Names that the library's functions use are defined, so no query fails before its first row."""

import builtins
import dis
import importlib
import pkgutil
import types

import graphloom
from graphloom.plans import dataset_queries


def globals_of(code):
    """The global names that functions of a code object use, those inside it included; the module's own lines have run anyway."""
    yield from (i.argval for i in dis.get_instructions(code) if i.opname == "LOAD_GLOBAL")
    for inner in code.co_consts:
        if isinstance(inner, types.CodeType):
            yield from globals_of(inner)


def test_every_global_name_is_defined():
    missing = []
    for found in pkgutil.walk_packages(graphloom.__path__, "graphloom."):
        module = importlib.import_module(found.name)
        with open(module.__file__) as f:
            names = set(globals_of(compile(f.read(), module.__file__, "exec")))
        missing += [(found.name, n) for n in sorted(names) if not hasattr(module, n) and not hasattr(builtins, n)]
    assert missing == []


def test_one_query_text_for_each_part(spark, sf_dir):
    """The texts that f21, f26, f32 and q04 to q19 read are dealt over the cores, one a part."""
    texts = dataset_queries.cypher_texts(spark, sf_dir)
    assert texts.select("id").distinct().count() == texts.count() == spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert texts.rdd.getNumPartitions() >= 32
