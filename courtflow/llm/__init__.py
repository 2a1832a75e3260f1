"""Training-data operators: ten corpus operations, their queries and the pipeline's stages."""
