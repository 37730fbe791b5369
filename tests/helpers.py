"""Small shared helpers: rows in, sorted rows out, and a look at plans."""


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def sorted_rows(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def plan(df):
    """The physical plan as text, before it runs."""
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The physical plan that AQE ended with."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString().split("== Initial Plan ==")[0]
