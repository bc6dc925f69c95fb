from corpusmill.operators import ml


def test_boosting_rounds_and_svm_iterations_are_the_references():
    assert ml.GRIDS["GBT"]["maxIter"] == ml.GRIDS["HGB"]["rounds"] == [200, 500]
    assert ml.PASSES == {"LR": 1000, "SVM": 5000}
