"""Pure-Python kernels that the Arrow UDFs run over batches of documents."""
