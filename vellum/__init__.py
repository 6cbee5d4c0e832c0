"""Page-layout analysis and text-line evaluation as DataFrame and SQL operators."""
