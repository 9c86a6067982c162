"""Training-data operators: text scans, de-duplication, packing, chat formatting and archives."""
