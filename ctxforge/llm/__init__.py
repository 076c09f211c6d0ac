"""Operations that a large training-text pipeline needs."""
