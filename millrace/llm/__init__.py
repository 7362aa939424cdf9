"""Operations for training-data pipelines at corpus scale. Nothing else in the library imports this subpackage."""
