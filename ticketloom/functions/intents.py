"""Intents and parameters of chat messages, as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Intents in the order in which they are tried.
INTENTS = {
    "data_import": (r"导入.*数据", r"上传.*文件", r"分析.*任务", r"处理.*jira", r"load.*data"),
    "clustering": (r"聚类.*分析", r"分类.*任务", r"cluster.*analysis", r"分组.*任务"),
    "results": (r"查看.*结果", r"显示.*分析", r"show.*results", r"导出.*结果"),
    "parameters": (r"调整.*参数", r"修改.*设置", r"change.*parameters"),
    "help": (r"帮助", r"怎么用", r"help", r"如何.*使用"),
}
#: The demonstration's intents.
DEMO_INTENTS = {
    "greeting": (r"你好", r"hello", r"hi"),
    "help": (r"帮助", r"help", r"怎么用"),
    "data_import": (r"导入", r"上传", r"数据", r"data"),
    "analysis": (r"分析", r"聚类", r"cluster"),
    "results": (r"结果", r"查看", r"显示"),
    "demo": (r"演示", r"demo"),
}
#: Patterns of parameters, in the order in which they are tried.
PARAMETERS = {
    "min_size": (r"最小.*?(\d+)", r"min.*?size.*?(\d+)", r"(\d+).*?最小"),
    "epsilon": (r"epsilon.*?(\d+\.?\d*)", r"ε.*?(\d+\.?\d*)"),
}


def intent(message: Column, table: dict = INTENTS) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    tests = [(name, low.rlike("(?d)" + "|".join(f"(?:{p})" for p in patterns))) for name, patterns in table.items()]
    first, *rest = tests
    return reduce(lambda c, t: c.when(t[1], F.lit(t[0])), rest, F.when(first[1], F.lit(first[0]))).otherwise(F.lit("unknown"))


def parameter(message: Column, name: str, default=None) -> Column:
    """The first group of the first pattern that matches, as int (min_size) or double (epsilon)."""
    kind = "int" if name == "min_size" else "double"
    found = [F.nullif(F.regexp_extract(F.coalesce(message, F.lit("")), "(?d)(?iu)" + p, 1), F.lit("")).try_cast(kind) for p in PARAMETERS.get(name, ())]
    return F.coalesce(*found, F.lit(default).cast(kind)) if found else F.lit(default).cast(kind)
