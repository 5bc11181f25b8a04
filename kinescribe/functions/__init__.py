"""Column -> Column functions: text cleaning and classification, caption layout, similarity."""
