"""symgraph.functions"""
