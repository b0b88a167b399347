"""Golden test: the four published confusion matrices, expanded back into
(label, prediction) rows, must give the published accuracy, macro P/R/F1 and
weighted F1."""
import pytest
from pyspark.sql import functions as F

from flowsight.operators import metrics as M

# Fixed values published with the reference's evaluation report.
CLASSES = ["Brute_Force", "HTTP_DDoS", "ICMP_Flood", "Normal", "Port_Scan", "Web_Crwling"]
GOLDEN = {
    "XGBoost": ([[9303, 0, 0, 0, 0, 0], [0, 59, 1, 2, 4, 0], [0, 1, 3, 2, 0, 1],
                 [1, 0, 0, 3929, 1, 1], [2, 1, 0, 2, 489, 0], [0, 0, 0, 2, 0, 2]],
                (0.9984789222077358, 0.8674562134229022, 0.8019377324204117, 0.8271513072432569, 0.998416974721749)),
    "LightGBM": ([[9303, 0, 0, 0, 0, 0], [0, 59, 0, 2, 4, 1], [0, 1, 3, 2, 0, 1],
                  [0, 1, 0, 3927, 1, 3], [2, 1, 1, 3, 487, 0], [0, 0, 0, 2, 0, 2]],
                 (0.9981891931044473, 0.829110510623826, 0.8011781940879227, 0.8028181139352139, 0.9981970138408552)),
    "CatBoost": ([[9299, 2, 0, 0, 2, 0], [1, 59, 2, 0, 3, 1], [0, 0, 4, 2, 0, 1],
                  [14, 0, 81, 3726, 40, 71], [17, 3, 1, 1, 467, 5], [0, 0, 0, 2, 0, 2]],
                 (0.9819643633202956, 0.6499448947295724, 0.8096485808666903, 0.6564140741236225, 0.987113687270037)),
    "RandomForest": ([[9286, 1, 0, 4, 12, 0], [0, 60, 1, 2, 3, 0], [0, 2, 3, 1, 0, 1],
                      [2, 1, 0, 3918, 9, 2], [5, 4, 0, 4, 481, 0], [0, 0, 0, 2, 0, 2]],
                     (0.995943792553962, 0.8301279811683179, 0.8009931086133198, 0.8072766561501584,
                      0.9959362574973933)),
}


@pytest.mark.parametrize("model", sorted(GOLDEN))
def test_published_metrics(spark, model):
    cm, expected = GOLDEN[model]
    cells = [(CLASSES[i], CLASSES[j], n) for i, row in enumerate(cm) for j, n in enumerate(row) if n]
    rows = (spark.createDataFrame(cells, "label string, prediction string, n int")
            .select("label", "prediction", F.explode(F.sequence(F.lit(1), F.col("n")))))
    got = M.classification_metrics(M.confusion_matrix(rows, labels=CLASSES)).first()
    names = ["accuracy", "precision_macro", "recall_macro", "f1_macro", "f1_weighted"]
    for name, want in zip(names, expected):
        assert abs(got[name] - want) < 1e-12, (model, name, got[name], want)
    assert rows.count() == 13806
