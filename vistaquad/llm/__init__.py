"""Operations of a training-data pipeline: deduplication, filtering, scanning, tokenising and archives of text."""
