"""Compares the plans chosen here with the plainer ones they replace, and prints one JSON line.

One job per metric, regexes without screens, a Python loop over the rows, NOT IN, and a window stand on
the other side.
"""

import json
import os
import re
import statistics
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from chatlens.functions.patterns import CARDS, DEFAULT_PATTERNS
from chatlens.functions.roles import ROLES
from chatlens.operators import clean, redact, stats
from chatlens.plans import adapters as A
from chatlens.session import build_session


def run(df):
    df.write.format("noop").mode("overwrite").save()


def count_kind_by_kind(messages):
    kinds = [[p.name for p in DEFAULT_PATTERNS if p.name != "LINK"], list(CARDS)]
    kinds += [[p.name] for p in DEFAULT_PATTERNS if p.name not in CARDS]
    regex = {p.name: p.regex for p in DEFAULT_PATTERNS}
    for names in kinds:
        test = F.lit(False)
        for name in names:
            test = test | F.col("MSGTEXT").rlike(regex[name])
        run(messages.filter(test).agg(F.count("*")))


def redact_without_screens(messages):
    text = F.col("MSGTEXT")
    for p in DEFAULT_PATTERNS:
        text = F.regexp_replace(text, p.regex, p.label)
    run(messages.withColumn("AN_MSGTEXT", text))


def redact_row_by_row(messages):
    rules = [(re.compile(p.regex, re.ASCII), p.label) for p in DEFAULT_PATTERNS]

    @F.udf("string")
    def redact_one(text):
        if text is not None:
            for regex, label in rules:
                text = regex.sub(label, text)
        return text

    run(messages.withColumn("AN_MSGTEXT", redact_one("MSGTEXT")))


def durations_metric_by_metric(chat):
    for metric in (F.avg, F.max, F.min):
        run(stats.chat_durations(chat).agg(metric("CHAT_DURATION")))


def without_human_by_not_in(chat):
    chat.createOrReplaceTempView("bench_chat")
    chat.filter(ROLES.is_human_agent()).createOrReplaceTempView("bench_agents")
    run(
        chat.sparkSession.sql(
            "SELECT count(DISTINCT INTERACTION_ID) FROM bench_chat"
            " WHERE INTERACTION_ID NOT IN (SELECT INTERACTION_ID FROM bench_agents)"
        )
    )


def fill_by_window(raw):
    first = Window.partitionBy("USER_ID").orderBy(F.col("EVENT_ID").cast("int"))
    rows = clean.remove_error_rows(raw)
    run(rows.withColumns({c: F.first(c).over(first) for c in clean.USER_ATTRIBUTES}))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "chatlens-plans",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    raw, chat = A.raw_log(spark, sf_dir), A.chat_log(spark, sf_dir).persist()
    messages = A.messages(spark, sf_dir).repartition(int(cpus)).persist()
    chat.count(), messages.count()
    pairs = {
        "pii_counts": (lambda: run(redact.pii_counts(messages)), lambda: count_kind_by_kind(messages)),
        "pii_redact": (lambda: run(redact.pii_redact(messages)), lambda: redact_without_screens(messages)),
        "pii_redact_vs_python": (lambda: run(redact.pii_redact(messages)), lambda: redact_row_by_row(messages)),
        "duration_summary": (lambda: run(stats.duration_summary(chat)), lambda: durations_metric_by_metric(chat)),
        "chats_without_human": (lambda: run(stats.chats_without_human(chat)), lambda: without_human_by_not_in(chat)),
        "fill_user_attributes": (lambda: run(clean.fill_user_attributes(clean.remove_error_rows(raw))), lambda: fill_by_window(raw)),
    }
    seconds = {}
    for name, sides in pairs.items():
        taken = []
        for side in sides:
            side()
            times = []
            for _ in range(3):
                start = time.perf_counter()
                side()
                times.append(time.perf_counter() - start)
            taken.append(round(statistics.median(times), 3))
        seconds[name] = {"here": taken[0], "plain": taken[1]}
    print(json.dumps({"unit": "sec", "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "plans": seconds}))
    spark.stop()


if __name__ == "__main__":
    main()
