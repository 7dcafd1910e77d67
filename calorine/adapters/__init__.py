"""Generic tables as inputs of the stages."""
