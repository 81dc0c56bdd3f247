"""Operations of a training-data pipeline: ten operators over texts, vectors and conversations."""
