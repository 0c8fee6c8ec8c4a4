STEP_SCHEMA = ("project_id string, path string, pos int, line_number int, type string, description string, "
               "function_name string, service struct<name:string,library:string,icon:string>, "
               "inputs array<string>, outputs array<string>")


def steps_df(spark, rows, path="s.py", project="p"):
    """rows: (type, description[, service name[, function]]) in step order."""
    out = []
    for i, r in enumerate(rows):
        typ, desc = r[0], r[1]
        svc = (r[2], r[2].lower(), None) if len(r) > 2 and r[2] else None
        fn = r[3] if len(r) > 3 else None
        out.append((project, path, i, i + 1, typ, desc, fn, svc, [], []))
    return spark.createDataFrame(out, STEP_SCHEMA)
