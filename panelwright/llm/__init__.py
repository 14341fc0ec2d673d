"""Operations for preparing large text corpora, each a chain of Spark DataFrame steps."""
