"""Operations that a training-data pipeline needs over documents and pages. Nothing else in the library imports this."""
