"""symgraph.operators"""
