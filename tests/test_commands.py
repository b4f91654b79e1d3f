import json

from nbgauge.__main__ import main


def test_corpus_to_prediction(spark, tmp_path, capsys):
    """A CSV corpus to metrics, to a model, to predictions for notebook files."""
    path = lambda name: str(tmp_path / name)
    rows = "".join(f'{i},1,"import sklearn\n{"x = 1\n" * (i % 40)}y = {i}",,1\n' for i in range(120))
    (tmp_path / "code.csv").write_text("kernel_id,cell_index,source,output_type,execution_count\n" + rows)
    (tmp_path / "md.csv").write_text("kernel_id,cell_index,source\n" + "".join(f"{i},2,# T {i}\n" for i in range(0, 120, 2)))
    (tmp_path / "pt.csv").write_text("Unnamed: 0,Id_x,PerformanceTier\n0,1,3\n")
    main(["csv-to-parquet", path("code.csv"), path("code"), "--files", "2"])
    main(["csv-to-parquet", path("md.csv"), path("md"), "--kind", "markdown"])
    main(["cell-metrics", path("code"), path("cm"), "--popularity", path("pop")])
    main(["cell-metrics", path("md"), path("mm"), "--kind", "markdown"])
    main(["aggregate-metrics", path("cm"), path("mm"), path("nm"), "--user-pt", path("pt.csv")])
    metrics = spark.read.parquet(path("nm"))
    assert metrics.count() == 120 and metrics.where("kernel_id = 1").first().PT == 3

    metrics.selectExpr(
        "kernel_id AS KernelId", "1000L AS TotalViews", "1L AS TotalVotes", "1 AS PerformanceTier_kerneluser", "0.5D AS topic_score",
        "0.5D AS score_scaled", "0.5D AS vote_scaled", "CAST(LOC AS DOUBLE) AS combined_score",
    ).write.parquet(path("scores"))
    capsys.readouterr()
    main(["train-model", path("nm"), path("scores"), path("reg"), "tree", "--classifier", "decision_tree", "--selection-ratio", "0.9"])
    key = json.loads(capsys.readouterr().out)["model_id"]
    main(["list-models", path("reg"), "--classifier", "decision_tree"])
    assert key in capsys.readouterr().out

    (tmp_path / "nb").mkdir()
    cells = [{"cell_type": "code", "source": "x = 1\n" * 30, "outputs": [], "execution_count": 1}]
    (tmp_path / "nb" / "a.ipynb").write_text(json.dumps({"cells": cells}))
    main(["predict", path("nb"), path("code"), path("pop"), path("reg"), key, path("predictions")])
    assert spark.read.parquet(path("predictions")).first().prediction == 1
    main(["extract-notebook-metrics", path("nb"), path("code"), path("pop"), path("nbm"), "--format", "json"])
    assert spark.read.json(path("nbm")).first().LOC == 31
